"""spark.read.format("waveform"): capture files as a data source, large text files in several tasks.

    spark.dataSource.register(WaveformSource)
    spark.read.format("waveform").option("layout", "samples").load(directory)

layout "files" (the default) gives the rows of ``waveform_files.load``, one for
each file. "samples" gives one for each number of a one-column or two-column
text file, MAT or HDF5 vector, with the byte at which its line begins; text
files of more than ``split`` bytes are read by ranges of bytes, each in a task
of its own: a line belongs to the range in which it begins. ``numbered`` gives
samples their places in their file, from counts of the ranges before theirs.
Both layouts can be streamed: each batch reads the files that are new.

Options: path (a folder or file, by any file system that Arrow opens), pattern
(of file names), recursive, fs (the rate of files that give none), preserve
(amplitudes), layout, split. A file, or a range, that can't be read gives one
row with its error.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from pulseloom.sources.waveform_files import SEGMENTS, parse

SAMPLES = "path string, range int, offset long, time double, value double, error string"
KINDS = (".csv", ".mat", ".h5", ".hdf5")
ERRORS = (ValueError, RuntimeError, OSError, KeyError, IndexError, csv.Error, struct.error, zlib.error)
#: Bytes of a range of a text file, rows of a record batch.
SPLIT, ROWS = 32 << 20, 1 << 16


@dataclass
class Piece(InputPartition):
    """A file, or the lines that begin in [begin, end) of it."""

    path: str
    number: int
    begin: int
    end: int
    size: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str, pattern: str = "*", recursive: bool = True) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the capture files in a folder, or of one file, in order."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=recursive, allow_not_found=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    rows = [(prefix + f.path, f.size, int(f.mtime_ns or 0)) for f in found if f.type == fs.FileType.File]
    return sorted(r for r in rows if PurePosixPath(r[0]).suffix.lower() in KINDS and fnmatch.fnmatch(PurePosixPath(r[0]).name, pattern))


def pieces_of(files: list[tuple[str, int, int]], layout: str, split: int) -> list[Piece]:
    out = []
    for path, size, _ in files:
        step = split if layout == "samples" and path.lower().endswith(".csv") else max(1, size)
        out += [Piece(path, i, at, min(at + step, size), size) for i, at in enumerate(range(0, max(1, size), step))]
    return out


def _numbers(line: bytes) -> list[float] | None:
    try:
        return [float(c) for c in line.decode("utf-8", "ignore").split(",") if c.strip()]
    except ValueError:
        return None


def text_samples(piece: Piece) -> Iterator[tuple]:
    """(offset, time, value) of the lines of one or two numbers that begin in a range; others are headings."""
    system, at = _opened(piece.path)
    with system.open_input_file(piece.path if at == piece.path else at) as f:
        f.seek(max(0, piece.begin - 1))
        begin = piece.begin
        if piece.begin and f.read(1) != b"\n":  # the line before goes on into this range
            begin = piece.begin + len(_rest_of_line(f))
        f.seek(begin)
        held = b""
        while begin < piece.end:
            block = f.read(1 << 20)
            lines = (held + block).split(b"\n")
            held = lines.pop() if block else b""
            for line in lines:
                if begin >= piece.end:
                    return
                values = _numbers(line)
                if values and len(values) <= 2:
                    yield begin, values[0] if len(values) == 2 else None, values[-1]
                elif values:
                    raise ValueError("more than two columns; read it as a file")
                begin += len(line) + 1
            if not block:
                return


def _rest_of_line(f) -> bytes:
    out = []
    while block := f.read(1 << 16):
        if (at := block.find(b"\n")) >= 0:
            out.append(block[: at + 1])
            break
        out.append(block)
    return b"".join(out)


class _Reads:
    """What the batch and the streaming reader share."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.recursive, self.layout = options.get("recursive", "true").lower() == "true", options.get("layout", "files")
        self.rate, self.preserve = float(options.get("fs", 1e9)), options.get("preserve", "false").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        if self.layout not in ("files", "samples"):
            raise ValueError("layout is files or samples")

    def files(self) -> list[tuple[str, int, int]]:
        return files_of(self.path, self.pattern, self.recursive)

    def read(self, piece: Piece | None) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if piece is None:  # there are no files
            return iter(())
        return self._samples(piece) if self.layout == "samples" else self._file(piece)

    def _content(self, piece: Piece) -> bytes:
        system, at = _opened(piece.path)
        with system.open_input_file(at) as f:
            return f.read()

    def _file(self, piece: Piece) -> Iterator[tuple]:
        name = PurePosixPath(piece.path).name
        try:
            rate, trigger, x, times = parse(piece.path, self._content(piece), self.rate, self.preserve)
            yield piece.path, name, rate, trigger, x.tolist(), None if times is None else times.tolist(), None
        except ERRORS as e:
            yield piece.path, name, None, None, None, None, f"{type(e).__name__}: {e}"

    def _samples(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        try:
            if piece.path.lower().endswith(".csv"):
                held = []
                for row in text_samples(piece):
                    held.append(row)
                    if len(held) == ROWS:
                        yield self._batch(piece, *zip(*held))
                        held = []
                if held:
                    yield self._batch(piece, *zip(*held))
            else:
                _, _, x, _ = parse(piece.path, self._content(piece), self.rate, True)
                for at in range(0, len(x), ROWS):
                    part = np.asarray(x[at : at + ROWS])
                    yield self._batch(piece, range(at, at + len(part)), [None] * len(part), part)
        except ERRORS as e:
            yield self._batch(piece, [None], [None], [None], f"{type(e).__name__}: {e}")

    @staticmethod
    def _batch(piece: Piece, offsets, times, values, error: str | None = None) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array([piece.path] * n), pa.array([piece.number] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(times, pa.float64()), pa.array(values, pa.float64()), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "range", "offset", "time", "value", "error"])


class WaveformReader(DataSourceReader):
    def __init__(self, options: dict):
        self.reads = _Reads(options)

    def partitions(self) -> list[Piece]:
        return pieces_of(self.reads.files(), self.reads.layout, self.reads.split)

    def read(self, partition: Piece):
        return self.reads.read(partition)


class WaveformStreamReader(DataSourceStreamReader):
    """An offset is the latest time of change that has been read, and the files of that time."""

    def __init__(self, options: dict):
        self.reads = _Reads(options)

    def initialOffset(self) -> dict:
        return {"time": "-1", "files": "[]"}

    def latestOffset(self) -> dict:
        files = self.reads.files()
        last = max((t for _, _, t in files), default=-1)
        return {"time": str(last), "files": json.dumps([p for p, _, t in files if t == last])}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        low, high, known = int(start["time"]), int(end["time"]), set(json.loads(start["files"]))
        last = set(json.loads(end["files"]))
        new = [f for f in self.reads.files() if (low < f[2] or (low == f[2] and f[0] not in known)) and (f[2] < high or (f[2] == high and f[0] in last))]
        return pieces_of(new, self.reads.layout, self.reads.split)

    def read(self, partition: Piece):
        return self.reads.read(partition)


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waveform"

    def schema(self) -> str:
        return SAMPLES if self.options.get("layout", "files") == "samples" else SEGMENTS

    def reader(self, schema) -> WaveformReader:
        return WaveformReader(dict(self.options))

    def streamReader(self, schema) -> WaveformStreamReader:
        return WaveformStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WaveformSource)


def numbered(samples: DataFrame) -> DataFrame:
    """samples with idx: their places in their file, from 0. Ranges are counted first; within one, order is that of the bytes."""
    good = samples.filter("error IS NULL")
    counts = good.groupBy("path", "range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("path", "range").orderBy("offset")) - 1
    return good.withColumn("_in", within).join(counts, ["path", "range"]).withColumn("idx", (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in")
