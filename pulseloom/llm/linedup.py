"""Fuzzy line deduplication: one line stays of each component of similar lines.

Equal lines are one node. A line is the set of its runs of eight characters;
48 minima of hashes of them are its signature, and twelve bands of four
minima name its buckets (two in a thousand pairs at the threshold are missed).
What meets in a bucket is verified by the exact Jaccard similarity of the sets,
links are joined to components by distributed union-find, and of each component
the first line in order of doc_id and line number stays.

Defined cases: a null text has no lines; lines without a word aren't judged and
always stay; a line of fewer than eight characters is one run; a null key comes
before all others; of repeated rows one is the first; an empty table gives an
empty result; further columns are ignored by ``lines`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from pulseloom.llm.common import BROADCAST_ROWS, SPACE_CHARS, attach, materialize, text_or_empty
from pulseloom.llm.lsh import near_components
from pulseloom.llm.shingles import char_shingles, mix

CHARS, THRESHOLD = 8, 0.8
MINIMA, BANDS, ROWS = 48, 12, 4
#: Characters that are hashed at once.
BLOCK = 1 << 17
#: Texts whose lines are signed together; of equal ones among them the first is.
SIGNED = 1024

_seeds = np.random.default_rng(19_970_303)
_A = _seeds.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEPS = _seeds.integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_order = np.concatenate([_seeds.permutation(MINIMA) for _ in range(-(-BANDS * ROWS // MINIMA))])
_CHOSEN = _order[: BANDS * ROWS].reshape(BANDS, ROWS)
_FACTOR = _seeds.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(points: np.ndarray) -> np.ndarray:
    """Hashes of the runs of eight code points: of two, then of two such, then of two of those."""
    h = mix(points.astype(np.uint64) + np.uint64(1))
    for width, factor in zip((1, 2, 4), _STEPS):
        h = h[:-width] * factor + h[width:]
    return mix(h)


def runs_of(line: str) -> np.ndarray:
    """Hashes of the runs of a line; of one shorter than a run, a hash of all of it."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _runs(points) if len(points) >= CHARS else char_shingles(line, CHARS)


def _blocks(lines: list[str]):
    """Parts of lines of about BLOCK characters, as (from, to)."""
    at = 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or size + len(lines[to]) <= BLOCK):
            size += max(len(lines[to]), CHARS)
            to += 1
        yield at, to
        at = to


def _all_runs(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of all lines, one line after the other, and how many each has: none where it is shorter than a run."""
    lengths = np.array([len(x) for x in lines])
    starts = np.cumsum(lengths) - lengths
    # Runs that begin in the last characters of a line reach into the next one and are left out.
    counts = np.maximum(lengths - CHARS + 1, 0)
    if not counts.any():
        return np.zeros(0, np.uint64), counts
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    where = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return _runs(points)[where], counts


def signatures(lines: list[str]) -> np.ndarray:
    """The minima of each line (none of them empty), lines x MINIMA."""
    out = np.empty((len(lines), MINIMA), np.uint32)
    for at, to in _blocks(lines):
        out[at:to] = _minima(lines[at:to])
    return out


def _minima(lines: list[str]) -> np.ndarray:
    hashes, counts = _all_runs(lines)
    long_ = np.flatnonzero(counts)
    out = np.empty((len(lines), MINIMA), np.uint32)
    if len(long_):
        first = (np.cumsum(counts) - counts)[long_]
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        scaled = np.empty_like(low)
        for k in range(MINIMA):
            np.multiply(low, _A[k], out=scaled)
            out[long_, k] = np.minimum.reduceat(scaled, first)
    for i in np.flatnonzero(counts == 0):
        out[i] = np.uint32(int(runs_of(lines[i])[0]) >> 32) * _A
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    per_band = (mix(minima.astype(np.uint64))[:, _CHOSEN] * _FACTOR).sum(axis=2, dtype=np.uint64)
    return mix(per_band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_KEYS = [f"k{i}" for i in range(BANDS)]


def _pass(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row for each line with a word: row (a number of its own), doc_id, line_no, node, and the keys of its bands where
    it is the first of its kind among some hundred texts."""

    def of(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in (batch.slice(at, SIGNED) for at in range(0, batch.num_rows, SIGNED)):
                doc, at, nodes, places, known = [], [], [], [], {}
                for i, t in enumerate(part.column(1).to_pylist()):
                    for k, line in enumerate(t.split("\n")):
                        if line.strip(SPACE_CHARS):
                            node = known.get(line)
                            if node is None:
                                node = known[line] = hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()
                                places.append(len(doc))
                            doc.append(i), at.append(k), nodes.append(node)
                keys = band_keys(signatures(list(known))) if known else np.zeros((0, BANDS), np.int64)
                first = np.ones(len(doc), bool)
                first[places] = False
                spread = np.zeros(len(doc), np.int64)
                spread[places] = np.arange(len(places))
                columns = [pa.array(np.arange(number, number + len(doc))), part.column(0).take(pa.array(doc, pa.int64())), pa.array(at, pa.int32()), pa.array(nodes, pa.binary())]
                columns += [pa.array(keys[spread, b] if len(keys) else spread, pa.int64(), mask=first) for b in range(BANDS)]
                number += len(doc)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "line_no", "node", *_KEYS])

    chosen = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = StructType([StructField("row", LongType()), StructField("doc_id", chosen.schema["doc_id"].dataType), StructField("line_no", IntegerType()), StructField("node", BinaryType()), *(StructField(k, LongType()) for k in _KEYS)])
    return chosen.mapInArrow(of, kind)


def _vectors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The set of runs of each line, in order, and weights of 1."""
    found = []
    for at, to in _blocks(texts):
        hashes, counts = _all_runs(texts[at:to])
        ends = np.cumsum(counts)
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            hashes[start:end].sort()
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        fresh[(ends - counts)[counts > 0]] = True
        cuts = np.concatenate(([0], np.cumsum(fresh)))[ends]
        sets = np.split(hashes[fresh], cuts[:-1])
        sets = [keys if n else runs_of(t) for keys, n, t in zip(sets, counts.tolist(), texts[at:to])]
        found += [(keys, np.ones(len(keys))) for keys in sets]
    return found


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each line with a word: doc_id, line_no (from 0), class_doc_id and class_line_no (the line that stays), class_size, kept."""
    written = materialize(_pass(docs, text, key), "lines")
    rows = written.select("row", "doc_id", "line_no", "node")
    # Columns of a fixed width are put together by hashing, without a sort. A node's keys are always the same; their
    # minimum holds one number where the first value would hold a mark as well.
    keys = written.filter("k0 IS NOT NULL").groupBy("node").agg(*[F.min(k).alias(k) for k in _KEYS])
    keys = materialize(keys.select("node", F.array(*_KEYS).alias("keys")), "line-bands")

    def content(nodes: DataFrame, n: int) -> DataFrame:
        # Lines without a word are no nodes, so that the join leaves them out.
        found = docs.select(F.explode(F.split(text_or_empty(text), "\n")).alias("text"))
        found = found.select(F.unhex(F.md5("text")).alias("node"), "text").join(F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes, "node", "left_semi")
        return materialize(found.groupBy("node").agg(F.first("text").alias("text")), "line-texts")

    labels = near_components(keys, content, _vectors, THRESHOLD)
    nodes = rows.groupBy("node").agg(F.count("*").alias("own")).join(labels, "node", "left").filter("own > 1 OR label IS NOT NULL")
    nodes = materialize(nodes.select("node", "own", F.coalesce("label", "node").alias("label")), "line-nodes")
    total = rows.count()
    members = attach(rows, nodes, "node", "own", total, "inner")
    classes = members.groupBy("label").agg(F.count("*").alias("class_size"), F.min(F.struct("doc_id", "line_no", "row")).alias("first"))
    classes = materialize(classes.select("label", "class_size", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), F.col("first.row").alias("first")), "line-classes")
    info = materialize(attach(nodes, classes, "label", "class_size", total, "inner").drop("label"), "line-info")
    out = attach(rows, info, "node", "own", total)
    single = F.col("class_size").isNull()
    return out.select(
        "doc_id", "line_no",
        F.when(single, F.col("doc_id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"),
        F.when(single, F.col("line_no")).otherwise(F.col("class_line_no")).alias("class_line_no"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(single, F.lit(True)).otherwise(F.col("row") == F.col("first")).alias("kept"),
    )


def clean(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the lines that don't stay taken out of their texts, and with the columns of docs. Keys must be unique."""
    gone = lines(docs, text, key).filter("NOT kept").groupBy(F.col("doc_id").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_key"), F.col(text).alias("_text")).join(gone, "_key", "left")
    numbered = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.transform(F.filter(numbered, lambda e: ~F.array_contains("_gone", e["i"])), lambda e: e["x"])
    fresh = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    return packed.withColumn("row", F.col("row").withField(text, fresh)).select("row.*")
