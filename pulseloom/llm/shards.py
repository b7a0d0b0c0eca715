"""Sharding by a minimax contiguous partition of ordered, atomic groups.

Groups (equal texts) are ordered by their digest. The smallest capacity is
searched at which a greedy pass needs no more than the given number of shards;
the shards are then cut there. The driver works on blocks of the digest space:
it first knows a few thousand block sums, and asks for finer ones only where a
cut may fall, until every such block is one group. So what it holds is bounded
by the number of shards, not by the corpus, and the capacity is exact.

A group larger than a fair share takes a shard for itself, and the others are
split over the shards that are left, so that one huge group doesn't let the
other shards run empty.

Defined cases: a null text is empty, of size ``overhead``; null keys and
repeated rows are rows like any other; an empty table gives an empty result;
further columns are ignored. If there are fewer groups than shards, some shards
stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import materialize, numbered, text_or_empty

#: Hex digits of the digest that name the first blocks, and by how many more each refinement splits one.
FIRST_DIGITS, MORE_DIGITS = 3, 2


@dataclass
class Block:
    """The groups whose digests start with prefix: their size, number and largest."""

    prefix: str
    size: int
    groups: int
    largest: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1


def _greedy(blocks: list[Block], capacity: int, shards: int, divisible: bool) -> tuple[bool, list[tuple[int, int]]]:
    """Fill shards up to capacity in order. divisible: blocks of several groups may be cut anywhere.

    Returns whether all fits, and the cuts as (block, taken from that block).
    """
    cuts, room, used = [], capacity, 1
    for i, b in enumerate(blocks):
        left = b.size
        if b.size > capacity and not (divisible and not b.atomic):
            return False, cuts
        while left > room:
            if used == shards:
                return False, cuts
            if divisible and not b.atomic:
                left -= room
            cuts.append((i, b.size - left))
            used, room = used + 1, capacity
        room -= left
    return True, cuts


def _least(blocks: list[Block], shards: int, low: int, divisible: bool) -> int:
    high = max(low, sum(b.size for b in blocks))
    while low < high:
        middle = (low + high) // 2
        if _greedy(blocks, middle, shards, divisible)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def _doubtful(blocks: list[Block], shards: int, largest: int) -> tuple[set[int], int]:
    """Indexes of the blocks in which the best partition may cut, and a lower bound on its capacity."""
    low = _least(blocks, shards, largest, True)
    high = _least(blocks, shards, low, False)
    if low == high:
        return set(), low
    # Cuts lie furthest left for the smallest capacity without division, furthest right for the largest with it.
    right = _greedy(blocks, high, shards, True)[1]
    left, room = [0], low
    for i, b in enumerate(blocks):
        if b.size > room:
            left += [i] * max(1, -(-b.size // low))
            room = low
        room = max(0, room - b.size)
    found = set()
    for k in range(min(shards - 1, max(len(right), len(left) - 1))):
        to = right[k][0] if k < len(right) else len(blocks) - 1
        start = left[k + 1] if k + 1 < len(left) else left[-1]
        found |= {i for i in range(max(0, min(start, to) - 1), min(len(blocks), to + 2)) if not blocks[i].atomic}
    return found, low


def _balance(blocks: list[Block], capacity: int, shards: int) -> list[int]:
    """First block of each shard after the first: near equal shards, none over capacity."""
    need = [0] * (len(blocks) + 1)  # shards that the blocks from here on need at this capacity
    ahead, total = 0, 0
    ends, sums = [0] * len(blocks), [0]
    for b in blocks:
        sums.append(sums[-1] + b.size)
    for i in range(len(blocks)):
        ahead = max(ahead, bisect_right(sums, sums[i] + capacity) - 1)
        ends[i] = ahead
    for i in range(len(blocks) - 1, -1, -1):
        need[i] = 1 + need[ends[i]]
    starts, at = [], 0
    for k in range(shards - 1):
        left = shards - k
        goal = sums[at] + (sums[-1] - sums[at]) / left
        end = bisect_right(sums, goal) - 1
        if end < len(blocks) and goal - sums[end] > sums[end + 1] - goal:
            end += 1
        end = min(max(end, at), ends[at] if at < len(blocks) else at)
        while end < len(blocks) and need[end] > left - 1:
            end += 1
        at = end
        starts.append(at)
    return starts


def partition(groups: DataFrame, shards: int) -> tuple[list[str], list[str], int]:
    """Where to cut groups (digest hex string, size long) into shards.

    Returns the digests at which shards 1.. of the ordinary groups start, the
    digests of groups that get a shard each, and the largest shard's size.
    """
    prefix = lambda n: F.substring("digest", 1, n).alias("prefix")
    summed = [F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest")]
    total = groups.agg(F.sum("size")).first()[0] or 0
    # Groups over a fair share: fewer than there are shards.
    alone, left, rest = [], shards, total
    for g in groups.filter(F.col("size") > total / shards).orderBy(F.desc("size"), "digest").collect():
        if left > 1 and g["size"] > rest / left:
            alone.append(g["digest"])
            left, rest = left - 1, rest - g["size"]
    others = groups.filter(~F.col("digest").isin(alone)) if alone else groups

    def of(df: DataFrame, digits: int) -> list[Block]:
        return sorted((Block(*r) for r in df.groupBy(prefix(digits)).agg(*summed).collect()), key=lambda b: b.prefix)

    blocks = of(others, FIRST_DIGITS)
    largest = max([b.largest for b in blocks], default=0)
    digits = FIRST_DIGITS
    while True:
        doubtful, low = _doubtful(blocks, left, largest)
        if not doubtful:
            break
        digits += MORE_DIGITS
        open_blocks = others.sparkSession.createDataFrame([(blocks[i].prefix,) for i in sorted(doubtful)], "at string")
        lengths = sorted({len(blocks[i].prefix) for i in doubtful})
        inside = None
        for n in lengths:
            part = others.withColumn("at", F.substring("digest", 1, n)).join(F.broadcast(open_blocks.filter(F.length("at") == n)), "at", "left_semi")
            inside = part if inside is None else inside.unionByName(part)
        finer = of(inside.drop("at"), digits)
        blocks = sorted([b for i, b in enumerate(blocks) if i not in doubtful] + finer, key=lambda b: b.prefix)
    starts = _balance(blocks, low, left)
    # A cut before block b: any digest from b's prefix on. Past the last block: nothing.
    return [blocks[i].prefix if i < len(blocks) else "g" for i in starts], alone, low


def assign(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", overhead: int = 16) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = text_or_empty(text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + overhead).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.sha2(t, 256).alias("digest"),
    )
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    cuts, alone, _ = partition(groups, shards)
    first = len(alone)
    # At most one comparison per shard, on literals: no join.
    ordinary = sum([(F.col("digest") >= c).cast("int") for c in cuts], F.lit(first))
    shard = F.coalesce(*[F.when(F.col("digest") == d, F.lit(i)) for i, d in enumerate(alone)], ordinary) if alone else ordinary
    placed = rows.withColumn("shard", shard.cast("int"))
    return numbered(placed, "shard", ["doc_id", "digest", "size", "text_crc32"], rows.count(), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
