"""Pulse detection: constant-false-alarm-rate and threshold by windows, array kernels for what needs suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import dsp


def cfar(samples: DataFrame, window: int = 64, guard: int = 8, pfa: float = 1e-4) -> DataFrame:
    """Samples whose power exceeds alpha times the mean power of the training cells on both sides.

    alpha is designed for the cells of one side. Samples without a full window
    on either side are never detected. Two bounded frames of one sort.
    """
    alpha = window * (pfa ** (-1.0 / window) - 1)
    w = Window.partitionBy("series_id").orderBy("idx")
    left, right = w.rowsBetween(-(window + guard), -(guard + 1)), w.rowsBetween(guard + 1, window + guard)
    rows = samples.withColumn("power", F.col("x") * F.col("x"))
    rows = rows.withColumns({
        "noise": (F.sum("power").over(left) + F.sum("power").over(right)) / (2 * window),
        "_ahead": F.count("*").over(left), "_behind": F.count("*").over(right),
    })
    full = (F.col("_ahead") == window) & (F.col("_behind") == window)
    return rows.filter(full & (F.col("power") > alpha * F.col("noise"))).drop("_ahead", "_behind")


def threshold_peaks(samples: DataFrame, k: float = 3.0) -> DataFrame:
    """Local maxima of the magnitude that reach mean + k sigma; a plateau counts at its middle, rounded down.

    Runs of equal samples are numbered, and each run is compared with its
    neighbours; the first and the last run never count.
    """
    w = Window.partitionBy("series_id").orderBy("idx")
    all_ = Window.partitionBy("series_id")
    m = samples.withColumn("m", F.abs("x"))
    m = m.withColumns({"limit": F.avg("m").over(all_) + k * F.stddev_pop("m").over(all_), "_new": F.coalesce((F.col("m") != F.lag("m").over(w)).cast("int"), F.lit(1))})
    runs = m.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("series_id", "_run").agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"), F.first("m").alias("peak_v"), F.first("limit").alias("limit"))
    r = Window.partitionBy("series_id").orderBy("_run")
    top = (F.col("peak_v") > F.lag("peak_v").over(r)) & (F.col("peak_v") > F.lead("peak_v").over(r)) & (F.col("peak_v") >= F.col("limit"))
    return runs.withColumn("_top", top).filter("_top").select("series_id", F.floor((F.col("_a") + F.col("_b")) / 2).alias("idx"), "peak_v")


def array_pulses(segments: DataFrame, fs: float, k: float = 3.0, separation_s: float = 0.0, method: str = "threshold") -> DataFrame:
    """Pulse positions of array segments by threshold or prominence, with refractory distance: series_id, pulse_no, idx, peak_v."""

    def run(batches):
        for pdf in batches:
            out = []
            for sid, x in zip(pdf["series_id"], pdf["samples"]):
                x = np.asarray(x, float)
                out += [(sid, no, int(i), float(abs(x[i]))) for no, i in enumerate(dsp.detect(x, fs, k, separation_s, method))]
            yield pd.DataFrame(out, columns=["series_id", "pulse_no", "idx", "peak_v"])

    return segments.select("series_id", "samples").mapInPandas(run, "series_id long, pulse_no long, idx long, peak_v double")


def delta_t_vector(segments: DataFrame, fs: float | str, k: float = 3.0, separation_s: float = 0.0, method: str = "threshold") -> DataFrame:
    """Detection and intervals of array segments in one: series_id, k, delta_t_s. Methods: threshold, prominence, cfar.

    fs: one rate, or the column with each segment's. Fewer than two pulses give no interval.
    """

    def run(batches):
        for pdf in batches:
            out = [(sid, no, float(v)) for sid, x, rate in zip(pdf["series_id"], pdf["samples"], pdf["rate"]) for no, v in enumerate(dsp.intervals(np.asarray(x, float), rate, k, separation_s, method))]
            yield pd.DataFrame(out, columns=["series_id", "k", "delta_t_s"])

    rate = F.col(fs) if isinstance(fs, str) else F.lit(float(fs))
    return segments.select("series_id", "samples", rate.alias("rate")).mapInPandas(run, "series_id long, k long, delta_t_s double")


def pulse_shapes(segments: DataFrame, fs: float, k: float = 3.0, back_ns: float = 10.0, forward_ns: float = 100.0) -> DataFrame:
    """Peak, rise, fall and width of each pulse of array segments."""

    def run(batches):
        for pdf in batches:
            out = [(sid, *row) for sid, x in zip(pdf["series_id"], pdf["samples"]) for row in dsp.morphology(np.asarray(x, float), dsp.detect(np.asarray(x, float), fs, k), fs, back_ns, forward_ns)]
            yield pd.DataFrame(out, columns=["series_id", "toa_idx", "v_peak", "t_r_ns", "t_f_ns", "fwhm_ns"])

    return segments.select("series_id", "samples").mapInPandas(run, "series_id long, toa_idx long, v_peak double, t_r_ns double, t_f_ns double, fwhm_ns double")


def pulse_windows(samples: DataFrame, pulses: DataFrame, back: int, forward: int, partitions: int | None = None) -> DataFrame:
    """Samples within [idx - back, idx + forward) of each pulse, by an equi-join on buckets of the window's length, in that many partitions (the session's without)."""
    size = back + forward
    p = pulses.select("series_id", F.col("idx").alias("pulse_idx"))
    p = p.withColumn("_b", F.explode(F.sequence(F.floor((F.col("pulse_idx") - back) / size), F.floor((F.col("pulse_idx") + forward - 1) / size))))
    s = samples.withColumn("_b", F.floor(F.col("idx") / size))
    if partitions:
        s, p = s.repartition(partitions, "series_id", "_b"), p.repartition(partitions, "series_id", "_b")
    return s.join(p, ["series_id", "_b"]).filter((F.col("idx") >= F.col("pulse_idx") - back) & (F.col("idx") < F.col("pulse_idx") + forward)).drop("_b")


def array_map(segments: DataFrame, kernel, column: str = "samples") -> DataFrame:
    """Apply a kernel on one array to each segment; the schema stays."""

    @F.pandas_udf(segments.schema[column].dataType)
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else np.asarray(kernel(np.asarray(a, float)), float))

    return segments.withColumn(column, run(column))


def envelope(segments: DataFrame) -> DataFrame:
    return array_map(segments, dsp.envelope)


def bandpass(segments: DataFrame, fs: float, low: float, high: float, order: int = 5) -> DataFrame:
    return array_map(segments, lambda x: dsp.bandpass(x, fs, low, high, order))


def denoise(segments: DataFrame, wavelet: str = "db4", mode: str = "hard", rule: str = "minimax", level: int | None = None) -> DataFrame:
    return array_map(segments, lambda x: dsp.denoise(x, wavelet, mode, rule, level))


def cancel_noise(segments: DataFrame, mu: float = 0.01, order: int = 32) -> DataFrame:
    from pulseloom.functions.recurrences import lms_cancel

    return array_map(segments, lambda x: lms_cancel(x, None, mu, order))


def preprocess(segments: DataFrame, fs: float, low: float | None = None, high: float | None = None, normalize: bool = True, use_envelope: bool = False, use_denoise: bool = True) -> DataFrame:
    """Band-pass, z-score, envelope and denoising in this order, in one pass over the arrays."""

    def run(x: np.ndarray) -> np.ndarray:
        if low is not None and high is not None:
            x = dsp.bandpass(x, fs, low, high)
        if normalize:
            x = (x - x.mean()) / x.std() if x.std() > 0 else x - x.mean()
        if use_envelope:
            x = dsp.envelope(x)
        return dsp.denoise(x) if use_denoise else x

    return array_map(segments, run)


def to_long(segments: DataFrame) -> DataFrame:
    return segments.select(*[c for c in segments.columns if c != "samples"], F.posexplode("samples").alias("idx", "x")).withColumn("idx", F.col("idx").cast("long"))


def count_changes(sign: Column, before: Column) -> Column:
    return (F.coalesce(sign != before, F.lit(False))).cast("int")
