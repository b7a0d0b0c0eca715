"""SimHash near-duplicates, found by equal deletion variants of fingerprint segments.

A fingerprint's bit is 1 where it is set in over half of the XXH64 hashes of a
text's word shingles, repeats included. Two fingerprints that differ in at most
d bits are cut into d // 2 + 1 segments, fewer than the d + 1 that would leave
one equal: one segment then differs in at most one bit. Every fingerprint is
indexed by all variants of its segments with one bit left out, so that such a
segment gives the two an equal key. Those that meet are verified on all bits,
and links are joined to components.

Distinct fingerprints are nodes, whatever number of documents has them; a key
meets 64 of a fingerprint's rows at most once, so that no key holds more than
one row in 64. What meets is read in order of keys: some members are compared
at once; a bucket above LIMIT is kept, its members that aren't connected yet
are dealt by the pieces of the other bits, of which one must be equal, and what
is still large is compared in pairs of blocks, those outside of the largest
component with all others.

Defined cases: a null text is empty; a text without words has fingerprint 0,
linked like any other; a text of fewer words than a shingle is one shingle;
null keys and repeated rows are rows like any other (a component of null keys
alone has a null id); an empty table gives an empty result; further columns are
ignored by ``classes`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import BROADCAST_ROWS, attach, materialize, text_or_empty
from pulseloom.llm.components import components

WORDS, DISTANCE, SEED = 3, 3, 42
#: Members of a bucket that are compared where they meet.
LIMIT = 1024
#: Bytes of a text whose words are split at once, shingles whose bits are counted at once, and pairs of rows compared at once.
CHUNK, SHINGLES, PAIRS = 1 << 20, 1 << 16, 1 << 22


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, of which only A-Z are lower-cased; a long text in parts that are cut at white space."""
    at = 0
    while len(text) - at > CHUNK:
        to = at + CHUNK
        while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield text[at:to].lower().split()
        at = to
    yield text[at:].lower().split()


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each set where over half of the shingles' hashes have it; 0 without words."""
    counts, n, held = np.zeros(64, np.int64), 0, []
    for part in _word_lists(text):
        held += part
        for begin in range(0, max(0, len(held) - words + 1), SHINGLES):
            some = held[begin : begin + SHINGLES + words - 1]
            hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(some[i:] for i in range(words)))), np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
        held = held[-(words - 1) :] if len(held) >= words else held
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """docs -> (doc_id, fp): the fingerprint as a signed number; texts are read where they lie."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text").cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _cuts(parts: int) -> list[tuple[int, int]]:
    """The first bit and the width of each of so many parts of 64 bits."""
    ends = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _piece(begin: int, width: int):
    return F.shiftrightunsigned("fp", begin).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")


#: Keys hold the number of the bit that is left out above so many bits of the segment.
KEY_BITS = 57


def _variants(distance: int) -> list:
    """The keys of a fingerprint: its segments without one of their bits, behind the number of that bit."""
    out = []
    for begin, width in _cuts(distance // 2 + 1):
        for bit in range(width):
            rest = _piece(begin, width).bitwiseAND(F.lit(~(1 << bit) & ((1 << width) - 1)) if width < 64 else F.lit(~(1 << bit) if bit < 63 else (1 << 63) - 1))
            # Only a segment of all 64 bits overlaps its number; keys that clash cost a comparison, no link.
            out.append(F.shiftleft(F.lit(begin + bit).cast("long"), KEY_BITS).bitwiseXOR(rest))
    return out


def _finer(distance: int):
    """The finer keys of a member of a bucket: distance + 1 pieces of the bits outside of the bucket's segment, one of which two similar members share."""
    number, out = F.shiftrightunsigned("key", KEY_BITS), None
    for begin, width in _cuts(distance // 2 + 1):
        other = [i for i in range(64) if not begin <= i < begin + width]
        keys = []
        for i in range(distance + 1):
            mask = sum(1 << b for b in other[len(other) * i // (distance + 1) : len(other) * (i + 1) // (distance + 1)])
            keys.append(F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
        mine = number.between(begin, begin + width - 1)
        out = F.when(mine, F.array(*keys)) if out is None else out.when(mine, F.array(*keys))
    return out


def connect(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the smallest index of its component under links of at most ``distance`` bits: each is met once."""
    labels, open_ = np.arange(len(fps)), np.arange(1, len(fps))
    front, label = np.zeros(min(1, len(fps)), np.int64), 0
    while len(open_):
        near = np.zeros(len(open_), bool)
        step = max(1, PAIRS // len(open_))
        for at in range(0, len(front), step):
            near |= (np.bitwise_count(fps[front[at : at + step], None] ^ fps[open_]) <= distance).any(0)
        if near.any():
            front = open_[near]
            labels[front] = label
        else:
            label, near = int(open_[0]), np.arange(len(open_)) == 0
            front = open_[:1]
        open_ = open_[~near]
    return labels


def _small_runs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the runs of equal keys, many runs of one size at once: every member with the least one that it is connected to."""
    for m in np.unique(sizes[sizes > 1]).tolist():
        runs = starts[sizes == m]
        step = max(1, PAIRS // (m * m))
        for at in range(0, len(runs), step):
            x = fps[runs[at : at + step, None] + np.arange(m)]
            near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= distance
            label = np.broadcast_to(np.arange(m), x.shape)
            while True:
                least = np.where(near, label[:, None, :], m).min(2)
                if (least == label).all():
                    break
                label = least
            row, i = np.nonzero(label != np.arange(m))
            yield x[row, label[row, i]], x[row, i]


def _meet(rows: DataFrame, distance: int) -> DataFrame:
    """rows (key, fp) -> links (a, b) within a key, and members of larger buckets (key, a): some rows wait, never a whole bucket."""
    small = 64

    def out(a, b, key=None) -> pa.RecordBatch:
        n = len(a)
        columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(key) if key is not None else pa.nulls(n, pa.int64())], ["a", "b", "key"])

    def of(batches):
        keys, fps, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["key", "fp"])
        for batch, last in _marked(batches, empty):
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
            ends = np.append(starts[1:], len(keys))
            sizes = ends - starts
            whole = np.ones(len(starts), bool)
            if not last and len(starts):
                whole[-1] = False
            over = (sizes > LIMIT) | (keys[starts] == large if large is not None else np.zeros(len(starts), bool))
            few = whole & ~over & (sizes <= small)
            for a, b in _small_runs(fps, starts[few], sizes[few], distance):
                yield out(a, b)
            for s, e in zip(starts[whole & ~over & ~few].tolist(), ends[whole & ~over & ~few].tolist()):
                label = connect(fps[s:e], distance)
                linked = np.flatnonzero(label != np.arange(e - s))
                yield out(fps[s:e][label[linked]], fps[s:e][linked])
            for s, e in zip(starts[over].tolist(), ends[over].tolist()):
                yield out(fps[s:e], None, keys[s:e])
            if len(starts):
                done = len(keys) if whole[-1] or over[-1] else int(starts[-1])
                large = int(keys[-1]) if over[-1] else None
                keys, fps = keys[done:], fps[done:]

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(of, "a long, b long, key long")


def _marked(batches: Iterable[pa.RecordBatch], end: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batches, then an empty one that is marked as the last."""
    for batch in batches:
        yield batch, False
    yield end, True


def _open(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """members (key, fp) of buckets that hold several components, with size, main (the largest component) and label."""
    known = members.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    known = materialize(known, "large")
    shares = known.groupBy("key", "label").agg(F.count("*").alias("share"))
    open_ = shares.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", "share").alias("main"), F.max("share").alias("share"), F.sum("share").alias("size"))
    open_ = open_.filter("labels > 1").select("key", "main", "size", (F.col("size") - F.col("share")).alias("asking"))
    return attach(known, materialize(open_, "open"), "key", "size", total, "inner")


def _blocks(open_: DataFrame) -> DataFrame:
    """Members of open buckets -> rows (key, fp) of pairs of blocks: members outside of the main component, and all of them."""
    half = LIMIT // 2
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / half)).cast("int")
    dealt = lambda salt, n: F.pmod(F.xxhash64("fp", F.lit(salt)), parts(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    asked = open_.filter("label <> main").withColumn("q", dealt(1, "asking")).withColumn("r", each("size"))
    held = open_.withColumn("r", dealt(2, "size")).withColumn("q", each("asking"))
    return asked.unionByName(held).select(F.xxhash64("key", "q", "r").alias("key"), "fp").distinct()


def components_of(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fps (fp), distinct -> (node, label) of all fingerprints that are linked to another one."""
    keys = materialize(_meet(fps.select(F.explode(F.array(*_variants(distance))).alias("key"), "fp"), distance), "met")
    links = keys.filter("key IS NULL").select("a", "b")
    labels = components(links)
    large = materialize(keys.filter("key IS NOT NULL").select("key", F.col("a").alias("fp")), "large")
    if not (n := large.count()):
        return labels
    finer = _open(large, labels, n).select(F.explode(_finer(distance)).alias("key"), "fp")
    keys = materialize(_meet(finer, distance), "met")
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b")
    labels = components(known.unionByName(keys.filter("key IS NULL").select("a", "b")))
    large = materialize(keys.filter("key IS NOT NULL").select("key", F.col("a").alias("fp")), "large")
    if not (n := large.count()):
        return labels
    blocks = _blocks(_open(large, labels, n))
    # The hashes deal about LIMIT members to a block; one that holds more is compared all the same.
    more = blocks.groupBy("key").applyInArrow(lambda block: _links_of(block, distance), "a long, b long")
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b")
    return components(known.unionByName(materialize(more, "links")))


def _links_of(block: pa.Table, distance: int) -> pa.Table:
    fps = block["fp"].to_numpy().view(np.uint64)
    label = connect(fps, distance)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return pa.table({"a": fps[label[linked]].view(np.int64), "b": fps[linked].view(np.int64)})


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """A row for each document: doc_id, fingerprint (hexadecimal), component_id (the smallest doc_id of its component)."""
    rows = materialize(fingerprints(docs, text, key, words), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    labels = components_of(fps.select("fp"), distance)
    total = rows.count()
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = materialize(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("_fps"))
    several = materialize(least.filter("_fps > 1"), "least")
    info = attach(named, several, "label", "_fps", total).select("fp", "n", F.when(F.col("_fps").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    info = materialize(info, "components")
    return attach(rows, info, "fp", "n", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The document of the smallest key of each component, with the columns of docs; rows of that key stay together."""
    stays = classes(docs, text, key, words, distance).filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    stays = materialize(stays, "stays")
    return docs.join(F.broadcast(stays) if stays.count() <= BROADCAST_ROWS else stays, key, "left_semi")
