"""Readers of waveform files: oscilloscope text, MAT version 5, HDF5, Parquet; and of configurations."""

from __future__ import annotations

import csv
import io
import struct
import zlib
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "path string, file_name string, fs_hz double, trigger_epoch double, samples array<double>, times array<double>, error string"

# Names under which such files keep their signal and rate.
SIGNAL_KEYS = ("x3", "data", "signal", "volts", "voltage", "y")
RATE_KEYS = ("fs", "samplerate", "f_s", "frecuencia")
#: Names in MAT files of ad-hoc captures, and the rate of those that give none.
AD_HOC_KEYS, AD_HOC_FS = ("y", "val", "Data", "Signal"), 10e6
LEAST = 100


def parse_trigger(date: str, clock: str) -> float:
    """Epoch seconds of '19 NOV 2025', '14:23:42' in UTC; 0 when unknown."""
    from datetime import datetime, timezone

    try:
        return datetime.strptime(f"{date.strip()} {clock.strip()}", "%d %b %Y %H:%M:%S").replace(tzinfo=timezone.utc).timestamp()
    except ValueError:
        return 0.0


def trigger_column(date, clock):
    """The same as a column."""
    text = F.concat_ws(" ", F.trim(date), F.trim(clock))
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss"))).cast("double"), F.lit(0.0))


def _numbers(cells: list[str]) -> list[float] | None:
    try:
        return [float(c) for c in cells]
    except ValueError:
        return None


def parse_text(content: str, default_fs: float) -> tuple[np.ndarray, float, float, np.ndarray | None]:
    """(samples, rate, trigger, times) of an oscilloscope table.

    Rows of numbers are data, all others are headings. Two columns are time and
    value; more in an even number are pairs of them, one after the other; of an
    odd number the first two count; one column is values. Empty cells are left
    out. Only a clock-like value counts as trigger time. A file without numbers,
    or with rows of numbers of different lengths, is an error.
    """
    date = clock = ""
    single, rows = [], []
    for cells in csv.reader(content.splitlines()):
        cells = [c.strip() for c in cells]
        if not any(cells):
            continue
        key = cells[0].replace(":", "").lower()
        if key == "date" and len(cells) > 1:
            date = cells[1]
        elif key == "time" and len(cells) > 1 and cells[1].count(":") == 2:
            clock = cells[1]
        values = _numbers([c for c in cells if c])
        if values is None:
            continue
        (single if len(values) == 1 else rows).append(values[0] if len(values) == 1 else values)
    times = None
    if not rows and not single:
        raise ValueError("no numbers in the file")
    if rows:
        width = len(rows[0])
        if any(len(x) != width for x in rows):
            raise ValueError("rows of numbers have different lengths")
        table = np.array(rows)
        if width > 2 and width % 2 == 0:
            times, x = table[:, 0::2].ravel("F"), table[:, 1::2].ravel("F")
        else:
            times, x = table[:, 0], table[:, 1]
    else:
        x = np.array(single)
    step = float(np.median(np.diff(times[:1000]))) if times is not None and len(times) > 1 else 0.0
    return x, 1 / step if step > 0 else default_fs, parse_trigger(date, clock), times


def _mat_elements(data: bytes):
    """(type, payload) of the data elements of a MAT-5 stream; compressed ones are opened."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:  # small element: type and size share the first word
            kind, size, body, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            body, step = at + 8, 8 + (size if kind == 15 else -(-size // 8) * 8)
        payload = data[body : body + size]
        if kind == 15:
            yield from _mat_elements(zlib.decompress(payload))
        else:
            yield kind, payload
        at += step


_MAT_TYPES = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}


def mat_variables(content: bytes) -> dict[str, np.ndarray]:
    """Real numeric matrices of a little-endian MAT-5 file by name."""
    if content[126:128] != b"IM":
        raise ValueError("not a little-endian MAT version 5 file")
    found = {}
    for kind, payload in _mat_elements(content[128:]):
        if kind != 14:
            continue
        parts = list(_mat_elements(payload))
        if len(parts) < 4 or parts[3][0] not in _MAT_TYPES:
            continue
        shape = np.frombuffer(parts[1][1], "<i4")
        values = np.frombuffer(parts[3][1], _MAT_TYPES[parts[3][0]]).astype(float)
        found[parts[2][1].decode("latin-1")] = values.reshape(shape, order="F")
    return found


def parse_mat(content: bytes, default_fs: float, keys: tuple[str, ...] = SIGNAL_KEYS) -> tuple[np.ndarray, float]:
    """The signal under a usual name, or else the longest vector; the rate under a usual name."""
    found = {k: v.ravel() for k, v in mat_variables(content).items() if max(v.shape) == v.size}
    x = next((found[k] for k in keys if k in found and found[k].size > LEAST), None)
    if x is None:
        x = max(found.values(), key=len, default=np.zeros(0))
    fs = next((float(v[0]) for k, v in found.items() if k.lower() in RATE_KEYS and v.size == 1), default_fs)
    return x, fs


def parse_hdf5(content: bytes, default_fs: float) -> tuple[np.ndarray, float]:
    """The first vector of an HDF5 file and its rate; needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the optional package h5py") from e
    found: dict = {"x": None, "fs": default_fs}

    def visit(name, item):
        if isinstance(item, h5py.Dataset):
            if item.ndim == 1 and item.size > LEAST and found["x"] is None:
                found["x"] = np.asarray(item, float)
            elif item.size == 1 and any(k in name.lower() for k in ("fs", "rate")):
                found["fs"] = float(np.asarray(item).ravel()[0])

    with h5py.File(io.BytesIO(content)) as f:
        f.visititems(visit)
        found["fs"] = float(f.attrs.get("fs", found["fs"]))
    return (np.zeros(0) if found["x"] is None else found["x"]), found["fs"]


def _finish(x: np.ndarray, times: np.ndarray | None, preserve: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Without NaN (times go with their samples), centred, and scaled to 1 unless amplitudes are to stay."""
    ok = ~np.isnan(x)
    x, times = x[ok], None if times is None else times[ok]
    x = x - x.mean() if len(x) else x
    top = np.abs(x).max() if len(x) else 0.0
    return (x if preserve or top == 0 else x / top), times


def parse(name: str, content: bytes, default_fs: float, preserve: bool, mat_keys: tuple[str, ...] = SIGNAL_KEYS) -> tuple:
    kind = PurePosixPath(name).suffix.lower()
    trigger, times = 0.0, None
    if kind == ".csv":
        x, fs, trigger, times = parse_text(content.decode("utf-8", "ignore"), default_fs)
    elif kind == ".mat":
        x, fs = parse_mat(content, default_fs, mat_keys)
    elif kind in (".h5", ".hdf5"):
        x, fs = parse_hdf5(content, default_fs)
    else:
        raise ValueError(f"unsupported file type {kind!r}")
    x, times = _finish(np.asarray(x, float), times, preserve)
    return fs, trigger, x, times


def load(spark: SparkSession, path: str, default_fs: float = 1e9, preserve_amplitude: bool = False, pattern: str | None = None, recursive: bool = True, mat_keys: tuple[str, ...] = SIGNAL_KEYS) -> DataFrame:
    """One row per file (see SEGMENTS). A file is one task's work, as its rows are in order. One that can't be read has
    no samples, and why in ``error``, which is null for all others."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                name = PurePosixPath(p).name
                try:
                    rows.append((p, name, *parse(p, content, default_fs, preserve_amplitude, mat_keys), None))
                except (ValueError, RuntimeError, OSError, KeyError, IndexError, csv.Error, struct.error, zlib.error) as e:
                    rows.append((p, name, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "file_name", "fs_hz", "trigger_epoch", "samples", "times", "error"])

    return reader.load(path).select("path", "content").mapInPandas(run, SEGMENTS)


def channel_files(files: DataFrame, channels: list[str], per_folder: bool = True) -> DataFrame:
    """Files (path, file_name) of each channel: those named exactly <channel>.csv where there are any (in the folder, or among all), else those that contain the name."""
    names = F.broadcast(files.sparkSession.createDataFrame([(c,) for c in channels], "channel string"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    hits = files.join(names, F.col("file_name").contains(F.col("channel")) & F.lower("file_name").endswith(".csv"))
    from pyspark.sql import Window

    exact = (F.col("file_name") == F.concat("channel", F.lit(".csv"))).cast("int")
    hits = hits.withColumn("_exact", exact).withColumn("_best", F.max("_exact").over(Window.partitionBy("channel", *([folder] if per_folder else []))))
    return hits.filter("_exact = _best").drop("_exact", "_best")


def latest(spark: SparkSession, directory: str, prefix: str) -> str:
    """Path of the newest Parquet file or folder entry of a prefix."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.parquet").option("recursiveFileLookup", "true").load(directory)
    row = found.agg(F.max_by("path", "modificationTime").alias("path")).first()
    if row is None or row["path"] is None:
        raise FileNotFoundError(f"no {prefix}*.parquet in {directory}")
    return row["path"]


def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    if not isinstance(config, dict):
        raise ValueError("the configuration must be a mapping")
    return config
