"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Equal texts are one node. A shingle of five words weighs its count in the text
times its inverse document frequency over all distinct texts. For each of 36
hash functions improved consistent weighted sampling (Ioffe 2010) draws one
shingle, so that two texts agree with a probability that is their weighted
Jaccard similarity. Twelve bands of three draws name the buckets; what meets in
a bucket is verified by exact weighted Jaccard similarity, and links are joined
to classes.

Document frequencies are exact for every shingle. Texts are dealt to chunks of
some thousands by a hash. Each chunk sends its distinct shingles, packed by
ranges, to be counted; a range answers each chunk with the frequencies of those
of its shingles that are in two texts or more, and a text keeps the frequencies
of its own shingles with it. So no table of shingles is collected or broadcast.

Defined cases: a null text is empty; equal texts are of one class, those
without a word too; a text of fewer than five words is one shingle; null keys
and repeated rows are rows like any other; an empty table gives an empty
result; further columns are ignored by ``classes`` and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import BROADCAST_ROWS, attach, distinct_texts, materialize, text_or_empty
from pulseloom.llm.lsh import in_chunks, joined, near_components, text_frequencies
from pulseloom.llm.shingles import mix, texts_words, weighted, word_shingles

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3

_seeds = np.random.default_rng(19_840_611)
_A = _seeds.integers(1, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _seeds.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 2048
_UNIT = np.float32(2.0**-24)


def _scatter(keys: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = keys[None, :] * factors
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _uniform(x: np.ndarray, shift: int) -> np.ndarray:
    """24 bits of x as a number in (0, 1)."""
    return ((x >> np.uint64(shift)).astype(np.uint32) & np.uint32(0xFFFFFF)).astype(np.float32) * _UNIT + _UNIT / 2


def weighted_sample(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The smallest hash value of each function, as bits: equal for two texts that draw the same shingle at the same level."""
    best = np.full(BANDS * ROWS, np.inf, np.float32)
    for at in range(0, len(keys), _BLOCK):
        k, logs = keys[at : at + _BLOCK], np.log(weights[at : at + _BLOCK]).astype(np.float32)
        x, y = _scatter(k, _A[0]), _scatter(k, _A[1])
        r = -np.log(_uniform(x, 40) * _uniform(x, 16))
        c = -np.log(_uniform(y, 40) * _uniform(y, 16))
        beta = ((x & np.uint64(0xFFFF)) ^ (y & np.uint64(0xFFFF))).astype(np.float32) * np.float32(2.0**-16)
        level = np.floor(logs / r + beta)
        value = np.log(c) - r * (level - beta + np.float32(1))
        np.minimum(best, value.min(axis=1), out=best)
    return best.view(np.uint32).astype(np.uint64)


def band_keys(sample: np.ndarray) -> np.ndarray:
    per_band = (mix(sample).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64)
    return mix(per_band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


class Idf:
    """Weights of shingles by their document frequencies; a shingle that is not given is in one text."""

    def __init__(self, keys: np.ndarray, frequency: np.ndarray, texts: int):
        order = np.argsort(keys)
        self.keys, self.frequency, self.texts = keys[order], frequency[order], texts

    def frequencies(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), np.uint32)
        if len(self.keys) and len(keys):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == keys
            out[known] = self.frequency[at[known]]
        return out

    def weigh(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of a text and their weights."""
        keys, counts = weighted(shingles)
        return keys, _weights(counts, self.frequencies(keys), self.texts)


def _weights(counts: np.ndarray, frequencies: np.ndarray, texts: int) -> np.ndarray:
    return counts * np.log1p(texts / frequencies)


def _shingles(texts: pa.Array):
    for words in texts_words(texts):
        yield word_shingles(words, WORDS)


def _pack(frequencies: np.ndarray) -> bytes:
    """The document frequencies of a text's distinct shingles, in their order; the text's bytes follow."""
    return len(frequencies).to_bytes(4, "little") + frequencies.astype("<u4").tobytes()


def _unpack(packed: bytes) -> tuple[str, np.ndarray]:
    n = int.from_bytes(packed[:4], "little")
    return packed[4 + 4 * n :].decode("utf-8"), np.frombuffer(packed, "<u4", n, 4)


def document_frequencies(content: DataFrame, n: int) -> DataFrame:
    """(chunk, features, texts): the shingles of each chunk that are in two texts or more, and in how many; several rows a chunk."""
    return text_frequencies(content, n, lambda texts: (weighted(x)[0] for x in _shingles(texts)))


def classes_of_texts(content: DataFrame, n: int) -> DataFrame:
    """content (node, text), n rows -> (node, label) of all nodes that are similar to another."""

    def sample(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        idf = Idf(joined(counted, "features", np.uint64), joined(counted, "texts", np.uint32), n)
        nodes, keys, packed = [], [], []
        texts = chunk["text"].combine_chunks()
        for node, s in zip(chunk["node"], _shingles(texts)):
            if len(s):
                own, counts = weighted(s)
                frequencies = idf.frequencies(own)
                nodes.append(node.as_py())
                keys.append(band_keys(weighted_sample(own, _weights(counts, frequencies, n))))
                packed.append(_pack(frequencies))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(nodes) + 1, BANDS), pa.int32()), flat)
        return pa.table([pa.array(nodes, pa.binary()), lists, pa.array(packed, pa.binary())], ["node", "keys", "frequencies"])

    def vectors(packed):
        texts, frequencies = zip(*map(_unpack, packed))
        found = [weighted(s) for s in _shingles(pa.array(texts, pa.large_string()))]
        return [(keys, _weights(counts, f, n)) for (keys, counts), f in zip(found, frequencies)]

    chunks, many = in_chunks(content, n)
    counted = document_frequencies(content, n).repartition(many, "chunk")
    sampled = chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(sample, "node binary, keys array<long>, frequencies binary")
    sampled = materialize(sampled, "bands")

    def texts_of(nodes, n):
        """The texts of nodes, behind their frequencies: those alone are written a second time."""
        if n <= BROADCAST_ROWS:
            nodes = F.broadcast(nodes)
        found = content.join(nodes, "node", "left_semi").join(sampled.select("node", "frequencies").join(nodes, "node", "left_semi"), "node")
        return materialize(found.select("node", F.concat("frequencies", F.col("text").cast("binary")).alias("text")), "met-texts")

    return near_components(sampled.select("node", "keys"), texts_of, vectors, THRESHOLD)


def _class_info(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, node, copies), for each node in a class of two rows or more its class and what stays of it, and the number of rows."""
    rows, content = distinct_texts(docs, text, key)
    nodes = rows.groupBy("node").agg(F.max("doc_id").alias("own_id"), F.sum("copies").alias("own"))
    nodes = materialize(nodes, "node-sizes")
    labels = classes_of_texts(content, nodes.count())
    total = rows.agg(F.sum("copies")).first()[0] or 0
    nodes = materialize(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "node-labels")
    sizes = nodes.groupBy("label").agg(F.max(F.struct("own_id", "node")).alias("top"), F.sum("own").alias("class_size")).filter("class_size > 1")
    sizes = materialize(sizes.select("label", F.col("top.own_id").alias("class_id"), F.col("top.node").alias("keep_node"), "class_size"), "classes")
    info = attach(nodes, sizes, "label", "class_size", total, "inner")
    return rows, materialize(info.select("node", "own", "class_id", "keep_node", "class_size"), "class-info"), total


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, class_id (the largest doc_id of its class), class_size, kept (whether it is that row)."""
    rows, info, total = _class_info(docs, text, key)
    out = attach(rows, info, "node", "own", total).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    single = F.col("class_size").isNull()
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keep_node")) & (F.col("_copy") == 1)
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(single, F.lit(True)).otherwise(stays).alias("kept"),
    )


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs for each class, the one with the largest key, with the columns of docs."""
    rows, info, total = _class_info(docs, text, key)
    stays = "doc_id <=> class_id AND node = keep_node"
    copies = materialize(attach(rows, info, "node", "own", total, "inner").filter(stays).select("node", "copies"), "stays")
    info = materialize(info.join(copies, "node", "left"), "keep-info")
    node = F.substring(F.unhex(F.sha2(text_or_empty(text), 256)), 1, 16)
    packed = docs.select(node.alias("node"), F.col(key).alias("doc_id"), F.struct(*docs.columns).alias("row"))
    marked = attach(packed, info, "node", "own", total).filter(f"class_id IS NULL AND keep_node IS NULL OR {stays}")
    repeated = F.coalesce("copies", F.lit(1)) > 1
    return marked.filter(~repeated).unionByName(marked.filter(repeated).dropDuplicates(["node"])).select("row.*")
