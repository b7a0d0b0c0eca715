"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the packing depends only on
how many pieces there are of each length. The driver packs that histogram: a
segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and bins in the same state are moved together. The result is
that of one global best-fit-decreasing pass, in memory that is bounded by the
capacity. Pieces then take their places by their number among those of their
length.

Defined cases: a null text is empty and has its end token alone; null keys and
repeated rows are packed like any other; an empty table gives an empty result;
further columns are ignored. A document longer than the capacity is cut into
full pieces, but for the first.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import materialize, numbered, text_or_empty

CAPACITY, END = 1024, 2
#: Characters that are encoded at once; a longer text is cut at spaces.
LONG = 1 << 18

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files of this machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranked(path: str):
    """A tiktoken encoding of a file of ranks, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by a byte-level BPE tokenizer file.

    The ids are computed from the same vocabulary's ranks where their file lies
    beside the tokenizer's, which takes a quarter of the time; the tests hold
    both to be equal over a whole table. A text with a special token goes
    through the tokenizer itself. Nothing is kept from one text to the next.
    """

    #: Such a tokenizer never joins across a single space between two other characters, the space going to what follows.
    _safe = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.ranked = _ranked(ranks) if os.path.exists(ranks) else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, part: str) -> bytes:
        if self.ranked is None or any(t in part for t in self.special):
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(part)
        found = array("I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts of about LONG characters, cut before plain spaces."""
        at = 0
        while cut := self._safe.search(text, at + LONG):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            yield self._ids(t) if len(t) <= LONG else b"".join(map(self._ids, self._parts(t)))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    last = end.to_bytes(4, "little")

    def cut(batches):
        encoder = _encoder(tokenizer)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids += last
                total = len(ids) // 4
                start, stop, piece = 0, (total - 1) % capacity + 1, 0
                while start < total:
                    row = doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])
                    for column, value in zip(out, row):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(cut, PIECES)


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: how many kinds of open bins have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        i = room + self.leaves
        while i:
            self.open[i] += change
            i //= 2

    def tightest(self, size: int) -> int:
        """The smallest remaining capacity of at least size that an open bin has, or -1."""
        i = size + self.leaves
        if self.open[i]:
            return size
        while i > 1 and (i % 2 or not self.open[i + 1]):
            i //= 2
        if i <= 1:
            return -1
        i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


@dataclass(frozen=True)
class Run:
    """Pieces number..number+count-1 of a length fill bins from ``bin`` on, ``each`` to a bin, from ``offset`` on."""

    length: int
    number: int
    count: int
    bin: int
    each: int
    offset: int


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit decreasing over counts of lengths. Returns the runs and the number of bins.

    The tightest bin for a piece stays the tightest for the next one of the same
    length while that fits, so each bin in turn takes as many as it can hold.
    """
    tree, bins, runs, used = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            bins.setdefault(room, []).append((first, count))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, count = capacity, used, -(-left // (capacity // length))
                used += count
            else:
                first, count = bins[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(count, left // each)
            for n, k in ((full, each), (1, left - full * each if full < count else 0)):
                if n and k and left:
                    runs.append(Run(length, number, n * k, first, k, capacity - room))
                    put(room - k * length, first, n)
                    number, left, first, count = number + n * k, left - n * k, first + n, count - n
            put(room, first, count)
    return runs, used


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(pieces_of(docs, tokenizer, capacity, end, text, key), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    by_length: dict[int, list] = {}
    for r in best_fit(histogram, capacity)[0]:
        by_length.setdefault(r.length, []).append((r.number, r.count, r.bin, r.each, r.offset))
    plan = docs.sparkSession.createDataFrame(
        list(by_length.items()), "length long, runs array<struct<number:long,count:long,bin:long,each:long,offset:long>>"
    )
    ranked = numbered(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], sum(histogram.values()), "_number")
    at = F.col("_number")
    run = F.filter("runs", lambda r: (at >= r["number"]) & (at < r["number"] + r["count"]))[0]
    placed = ranked.join(F.broadcast(plan), "length").withColumn("_run", run).withColumn("_at", at - F.col("_run.number"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run.bin") + F.expr("_at div _run.each")).alias("sequence_id"),
        (F.col("_run.offset") + F.expr("_at % _run.each") * F.col("length")).alias("offset"),
    )
