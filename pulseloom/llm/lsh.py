"""From band keys to verified components, without pairs of all members of a bucket.

Buckets are compared in blocks of bounded size. A small bucket is one block, in
which every pair that is not yet connected is compared. A large one is dealt
over blocks that all hold its centre as well. Once what is linked so has been
joined to components, only buckets that hold several components are looked at
again: the members outside the largest one are compared with all other members,
in blocks. Of large buckets, members go first that can't be similar to any
other, because too much of their weight is on features that no other member of
such a bucket has. So no two members of a bucket stay apart unless they have
been compared, can't be similar, or are connected anyway. Links leave a block,
pairs never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import BROADCAST_ROWS, attach, materialize
from pulseloom.llm.components import components
from pulseloom.llm.shingles import weighted, weighted_jaccard

#: Members of a bucket that are compared in one block, and of the blocks of a larger bucket about.
SMALL, SHARE = 64, 48
#: Rows of a block whose pairs are measured without a product of matrices, and characters whose vectors are built at once.
FEW, TOGETHER = 4, 1 << 16
#: Features that are multiplied at once.
FEATURES = 1 << 14
#: Texts of a chunk, on average, and characters of all texts for each range of features.
CHUNK_TEXTS, RANGE_CHARS = 2048, 1 << 23
#: Bands whose buckets are compared first; the others then mostly hold one component.
FIRST_BANDS = 3
#: Bits of a band's key; the band (below 128) stands before them. Keys that clash cost a comparison, no link.
KEY_BITS = 56

#: Texts (node, text), one row each, of the given nodes and their number. Its result is read several times.
Content = Callable[[DataFrame, int], DataFrame]
Vectors = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]
#: The distinct features of each text of an array.
Features = Callable[[pa.Array], Iterable[np.ndarray]]


def overlaps(vecs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each two vectors a bound on the sum of the smaller weights: that of the square roots of their products.

    It is exact where the weights are equal. Features of one vector alone add
    nothing; the others are multiplied in blocks.
    """
    n = len(vecs)
    keys = np.concatenate([k for k, _ in vecs])
    owner = np.repeat(np.arange(n), [len(k) for k, _ in vecs])
    roots = np.sqrt(np.concatenate([w for _, w in vecs]).astype(np.float32))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    column = np.cumsum(begins) - 1
    shared = np.bincount(column)[column] > 1 if len(keys) else begins
    column = np.cumsum(begins[shared]) - 1  # of the features that two vectors have, in order
    row, value = owner[order][shared], roots[order][shared]
    out = np.zeros((n, n), np.float32)
    many = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, many, FEATURES):
        part = slice(*np.searchsorted(column, (at, at + FEATURES)))
        block = np.zeros((n, min(FEATURES, many - at)), np.float32)
        block[row[part], column[part] - at] = value[part]
        out += block @ block.T
    return out


def linked(vecs: list[tuple[np.ndarray, np.ndarray]], labels: list, asks: list[bool], threshold: float) -> list[tuple[int, int]]:
    """Rows of a block that are similar: a forest that connects all that the block's pairs connect.

    Pairs are measured exactly unless a bound on their similarity is below the
    threshold, they are in one component already, or neither of them asks. A
    few rows need no bound but that of their sums.
    """
    first: dict = {}
    parent = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sums = [float(v[1].sum()) for v in vecs]
    if len(vecs) <= FEW:
        least = threshold * (1 - 1e-4)
        pairs = [(i, j) for i in range(len(vecs)) for j in range(i) if (asks[i] or asks[j]) and min(sums[i], sums[j]) >= least * max(sums[i], sums[j], 1e-300)]
    else:
        total, asking = np.array(sums), np.array(asks, bool)
        # both / (a + b - both) >= t where both >= t (a + b) / (1 + t); single precision leaves a margin.
        near = overlaps(vecs) >= (total[:, None] + total[None, :]) * (threshold / (1 + threshold) * (1 - 1e-4))
        near &= (asking[:, None] | asking[None, :]) & (total > 0)[:, None]
        pairs = zip(*(x.tolist() for x in np.nonzero(np.tril(near, -1))))
    found = []
    for i, j in pairs:
        if root(i) != root(j) and weighted_jaccard(vecs[i], vecs[j]) >= threshold:
            parent[root(i)] = root(j)
            found.append((i, j))
    return found


def _compare(blocks: DataFrame, content: DataFrame, vectors: Vectors, threshold: float) -> DataFrame:
    """blocks (block, node, label, ask) -> links (a, b). Blocks come one after the other in each task's rows.

    The vectors of several small blocks are built at once, up to TOGETHER characters.
    """

    def links(held: list[list]) -> list[tuple[bytes, bytes]]:
        vecs = vectors([text for rows in held for text, *_ in rows])
        found, at = [], 0
        for rows in held:
            _, nodes, labels, asks = zip(*rows)
            found += [(nodes[i], nodes[j]) for i, j in linked(vecs[at : at + len(rows)], labels, asks, threshold)]
            at += len(rows)
        return found

    def of(batches):
        at, held, size = None, [], 0
        for batch in batches:
            found = []
            for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "text", "node", "label", "ask"))):
                if block != at or not held:
                    if size >= TOGETHER:
                        found += links(held)
                        held, size = [], 0
                    held.append([])
                    at = block
                held[-1].append(row)
                size += len(row[0])
            yield _links(found)
        if held:
            yield _links(links(held))

    rows = blocks.join(content, "node").select("block", "text", "node", "label", "ask")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(of, "a binary, b binary")


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def _parts(n: str):
    return F.ceil(F.col(n) / SHARE).cast("int")


def _several(members: DataFrame, total: int) -> DataFrame:
    """Members (key, node, n, label) of buckets with several labels, with size, main (the commonest label) and asking (others' members)."""
    shares = members.groupBy("key", "label").agg(F.count("*").alias("share"))
    by_key = shares.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", "share").alias("main"), F.max("share").alias("share"), F.sum("share").alias("size"))
    open_ = by_key.filter("labels > 1").select("key", (F.col("size") - F.col("share")).alias("asking"), "main", "size")
    return attach(members.drop("n"), materialize(open_, "open"), "key", "size", total, "inner")


def _dealt(salt: int, parts):
    return F.pmod(F.xxhash64("node", F.lit(salt)), parts)


def in_chunks(content: DataFrame, n: int) -> tuple[DataFrame, int]:
    """content (node, text), n rows -> (chunk, node, text) and the number of chunks."""
    chunks = max(1, n // CHUNK_TEXTS)
    return content.select(F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int").alias("chunk"), "node", "text").repartition(chunks, "chunk"), chunks


def _blobs(columns: list[list], names: list[str]) -> pa.Table:
    kinds = [pa.binary() if name in ("features", "texts") else pa.int32() for name in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _planes(keys: np.ndarray) -> bytes:
    """Numbers in order, byte by byte of all of them: the first bytes, which repeat, then pack well."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _ranges(chunk: pa.Table, features: Features, ranges: int) -> pa.Table:
    """The distinct features of a chunk of texts, and in how many of them each is; a row for each range of features."""
    found = list(features(chunk["text"].combine_chunks()))
    keys, n = weighted(np.concatenate(found) if found else np.zeros(0, np.uint64))
    cuts = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cuts))
    parts = [slice(cuts[i], cuts[i + 1]) for i in some]
    own = [chunk["chunk"][0].as_py()] * len(some)
    return _blobs([some, own, [_planes(keys[x]) for x in parts], [n[x].astype("<u4").tobytes() for x in parts]], ["range", "chunk", "features", "texts"])


def _counted(rows: pa.Table) -> pa.Table:
    """Rows of one range -> for each chunk its features that are in two texts or more, with the number of those texts."""
    keys = [_unplaned(x) for x in rows["features"].to_pylist()]
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate([np.frombuffer(x, "<u4") for x in rows["texts"].to_pylist()])
    total = np.bincount(which, weights=n)[which].astype("<u4")
    parts = [(k[t > 1].tobytes(), t[t > 1].tobytes()) for k, t in zip(keys, np.split(total, sizes))]
    return _blobs([rows["chunk"].to_pylist(), [k for k, _ in parts], [t for _, t in parts]], ["chunk", "features", "texts"])


def text_frequencies(content: DataFrame, n: int, features: Features) -> DataFrame:
    """(chunk, features, texts): the features of each chunk that are in two texts or more, and in how many; several rows a chunk.

    A chunk sends each of its features once, packed by ranges of their hashes,
    so that a feature of all texts is one number from each chunk; a range
    answers each chunk.
    """
    ranges = 1 + (content.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE_CHARS
    parts = in_chunks(content, n)[0].groupBy("chunk").applyInArrow(lambda chunk: _ranges(chunk, features, ranges), "range int, chunk int, features binary, texts binary")
    return parts.repartition(ranges, "range").groupBy("range").applyInArrow(_counted, "chunk int, features binary, texts binary")


def joined(blobs: pa.Table, column: str, kind) -> np.ndarray:
    """The numbers in the rows of a column of text_frequencies, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in blobs[column].to_pylist())])


def _able(content: DataFrame, n: int, vectors: Vectors, threshold: float) -> DataFrame:
    """The nodes that have at least the threshold's share of their weight on features that another of the nodes has too.

    Similarity can't exceed that share.
    """

    def features(texts: pa.Array):
        for at in range(0, len(texts), 256):
            for keys, _ in vectors(texts.slice(at, 256).to_pylist()):
                yield keys

    def able(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        shared, found = np.sort(joined(counted, "features", np.uint64)), []
        for at in range(0, chunk.num_rows, 256):
            part = chunk.slice(at, 256)
            for node, (keys, weights) in zip(part["node"].to_pylist(), vectors(part["text"].to_pylist())):
                place = np.searchsorted(shared, keys)
                held = weights[shared[np.minimum(place, len(shared) - 1)] == keys].sum() if len(shared) else 0
                if held >= weights.sum() * (threshold - 1e-9):
                    found.append(node)
        return pa.table([pa.array(found, pa.binary())], ["node"])

    chunks, many = in_chunks(content, n)
    counted = text_frequencies(content, n, features).repartition(many, "chunk")
    return chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(able, "node binary")


def near_components(keys: DataFrame, content: Content, vectors: Vectors, threshold: float) -> DataFrame:
    """keys (node, keys: one per band) -> (node, label) of all nodes that are linked to another."""
    own = F.xxhash64("node")
    dealt = keys.select("node", own.alias("_h"), F.posexplode("keys").alias("band", "key"))
    # The band comes first in a key, so that the least key of some is of the first band and buckets need no other column.
    dealt = dealt.select("node", "_h", F.shiftleft(F.col("band").cast("long"), KEY_BITS).bitwiseOR(F.shiftrightunsigned("key", 64 - KEY_BITS)).alias("key"))
    # Columns of a fixed width only, so that buckets are counted by hashing; the centre is the member of the least hash.
    buckets = dealt.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("_h").alias("_set"), F.min("_h").alias("centre"))
    # The same members meet in several bands: one bucket stands for all.
    buckets = buckets.filter("n > 1").groupBy("n", "_set", "centre").agg(F.min("key").alias("key"))
    buckets = materialize(buckets.select("key", F.shiftrightunsigned("key", KEY_BITS).cast("int").alias("band"), "n", "centre"), "buckets")
    bands = keys.select(F.size("keys")).first()
    total = keys.count() * bands[0] if bands else 0
    members = materialize(attach(dealt.drop("_h"), buckets, "key", "n", total, "inner"), "members")
    met = materialize(members.select("node").distinct(), "met")
    texts = content(met, met.count())

    first = members.filter(F.col("band") < FIRST_BANDS)
    large = first.filter(F.col("n") > SMALL)
    of_part = lambda part: F.xxhash64("key", part).alias("block")
    centres = large.filter(own == F.col("centre")).withColumn("part", F.explode(F.sequence(F.lit(0), _parts("n") - 1)))
    blocks = (
        first.filter(F.col("n") <= SMALL).select(F.col("key").alias("block"), "node")
        .unionByName(large.filter(own != F.col("centre")).select(of_part(_dealt(1, _parts("n")).cast("int")), "node"))
        .unionByName(centres.select(of_part(F.col("part")), "node"))
    )
    blocks = blocks.withColumns({"label": F.col("node"), "ask": F.lit(True)})
    links = materialize(_compare(blocks, texts, vectors, threshold), "links")
    labels = components(links)

    rest = members.filter((F.col("band") >= FIRST_BANDS) | (F.col("n") > SMALL)).join(labels, "node", "left")
    rest = rest.select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    rest = materialize(_several(rest, total), "rest")
    large = rest.filter(F.col("size") > SMALL)
    doubtful = materialize(large.select("node").distinct(), "doubtful")
    if n := doubtful.count():
        own_texts = texts.join(F.broadcast(doubtful) if n <= BROADCAST_ROWS else doubtful, "node", "left_semi")
        able = materialize(_able(own_texts, n, vectors, threshold), "able")
        large = large.join(F.broadcast(able) if able.count() <= BROADCAST_ROWS else able, "node", "left_semi")
        left = materialize(_several(large.select("key", "node", F.col("size").alias("n"), "label"), total), "rest")
        rest = rest.filter(F.col("size") <= SMALL).unionByName(left)
    elif not rest.limit(1).count():
        return labels
    small = rest.filter(F.col("size") <= SMALL).select(F.col("key").alias("block"), "node", "label", F.lit(True).alias("ask"))
    large = rest.filter(F.col("size") > SMALL)
    asking, rows = _parts("asking"), _parts("size")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    pair = F.xxhash64("key", "q", "r").alias("block")
    asked = large.filter("label <> main").withColumn("q", _dealt(2, asking).cast("int")).withColumn("r", each(rows))
    held = large.withColumn("r", _dealt(3, rows).cast("int")).withColumn("q", each(asking))
    blocks = small.unionByName(asked.select(pair, "node", "label", F.lit(True).alias("ask"))).unionByName(held.select(pair, "node", "label", F.lit(False).alias("ask")))
    more = materialize(_compare(blocks, texts, vectors, threshold), "links")
    if not more.count():
        return labels
    # Components of components: the labels stand for their members.
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b")
    return components(known.unionByName(more))
