"""Window verdicts, baseline detectors and their comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import dsp, recurrences
from pulseloom.operators.detect import denoise, threshold_peaks, to_long
from pulseloom.operators.features import NAMES, descriptors, scored, sliding
from pulseloom.operators.track import cusum

VERDICT = "pd_present boolean, confidence double, n_events long, far_estimate double, dominant_descriptor string"


def _dominant(clean: DataFrame, size: int) -> DataFrame:
    """The descriptor whose values over sub-windows have the largest kurtosis, to 9 decimals; the first of NAMES on ties."""
    table = descriptors(clean, min(256, size // 2), min(128, size // 4))
    peaked = [F.round(F.kurtosis(F.when(~F.isnan(n), F.col(n))) + 3, 9).alias(n) for n in NAMES]
    values = table.groupBy("series_id").agg(*peaked)
    ranked = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("value"), F.lit(-i).alias("place"), F.lit(n).alias("name"))) for i, n in enumerate(NAMES)]))
    return values.select("series_id", F.array_max(ranked)["name"].alias("_name"))


def segment_verdicts(segments: DataFrame, fs: float, size: int, k: float = 3.0, threshold: float = 5.0, drift: float = 0.5, n_max: int = 20, partitions: int | None = None) -> DataFrame:
    """A verdict for each segment of ``size`` samples (64 at least, shorter segments have none): series_id, pd_present, confidence, n_events, far_estimate, dominant_descriptor.

    The denoised samples are dealt by segment once; peaks, CUSUM on the
    intervals and descriptors read them from there. A segment with fewer than
    three pulses is absent, and one pulse alone counts as none. far_estimate is
    the share of alarms in the first half of the intervals.
    """
    clean = to_long(denoise(segments.select("series_id", "samples"), "db4", "soft", "universal"))
    if partitions:
        clean = clean.repartition(partitions, "series_id")
    order = Window.partitionBy("series_id").orderBy("idx")
    pulses = threshold_peaks(clean, k).withColumn("k", F.row_number().over(order) - 2)
    intervals = pulses.withColumn("delta_t_s", (F.col("idx") - F.lag("idx").over(order)) / fs).filter("k >= 0")
    tracked = cusum(intervals, threshold=threshold, drift=drift).withColumn("_half", F.floor(F.count("*").over(Window.partitionBy("series_id")) / 2))
    found = tracked.groupBy("series_id").agg(
        (F.count("*") + 1).alias("n_events"),
        (F.count_if(F.col("alarm") & (F.col("k") < F.col("_half"))) / F.greatest(F.first("_half"), F.lit(1))).alias("_far"),
    )
    rows = _dominant(clean, size).join(found, "series_id", "left")
    present = F.coalesce(F.col("n_events") >= 3, F.lit(False))
    confidence = F.least(F.col("n_events") / n_max, F.lit(1.0)) * (1 - F.col("_far"))
    return rows.select(
        "series_id", present.alias("pd_present"), F.when(present, F.bround(confidence, 4)).otherwise(0.0).alias("confidence"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.when(present, F.bround("_far", 4)).otherwise(0.0).alias("far_estimate"), F.when(present, F.coalesce("_name", F.lit("none"))).otherwise("none").alias("dominant_descriptor"),
    )


def campaign_verdicts(samples: DataFrame, fs: float, window_s: float, overlap_s: float = 0.0, partitions: int | None = None, **options) -> DataFrame:
    """A verdict for each full time window: series_id, win_id, t_start, t_end and the verdict's columns.

    Windows are dealt in that many partitions; the session's without.
    """
    size = max(int(window_s * fs), 64)
    step = max(int((window_s - overlap_s) * fs), 1)
    rows = sliding(samples, size, size - step).groupBy("series_id", "win_id")
    segments = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("samples"))
    segments = segments.select(F.struct("series_id", "win_id").alias("series_id"), "samples")
    verdicts = segment_verdicts(segments, fs, size, partitions=partitions, **options)
    begin = F.col("series_id.win_id") * step
    return verdicts.select("series_id.series_id", "series_id.win_id", (begin / fs).alias("t_start"), ((begin + size) / fs).alias("t_end"), *verdicts.columns[1:])


def campaign_summary(verdicts: DataFrame) -> DataFrame:
    """One row: windows, share present (2 places), mean confidence (4), first detection, false alarms a minute (4). Zeros for no window."""
    minutes = (F.max("t_end") - F.min("t_start")) / 60
    return verdicts.agg(
        F.count("*").alias("total_windows"),
        F.coalesce(F.round(100 * F.avg(F.col("pd_present").cast("double")), 2), F.lit(0.0)).alias("pd_present_pct"),
        F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("mean_confidence"),
        F.min(F.when(F.col("pd_present"), F.col("t_start"))).alias("first_detection_s"),
        F.coalesce(F.round(F.try_divide(F.sum("far_estimate"), minutes), 4), F.lit(0.0)).alias("false_alarm_rate_per_min"),
    )


def energy_alarms(samples: DataFrame, size: int = 1024, change: float = 0.5, k: float = 3.0) -> DataFrame:
    """Half-overlapping windows with their energy, whether they alarm above the earlier ones' mean + k sigma, and whether they lie after the change."""
    return _window_alarms(samples, F.sum(F.col("x") * F.col("x")), size, change, k, two_sided=False)


def zcr_alarms(samples: DataFrame, size: int = 1024, change: float = 0.5, k: float = 3.0) -> DataFrame:
    """The same for sign changes per sample, on either side.

    Changes are counts, so that a window exactly at the limit is common; sums of counts decide it alike in any order.
    """
    return _window_alarms(samples, F.sum("_turn"), size, change, k, two_sided=True, counts=True)


def _window_alarms(samples: DataFrame, measure, size: int, change: float, k: float, two_sided: bool, counts: bool = False) -> DataFrame:
    n = samples.groupBy("series_id").agg((F.max("idx") + 1).alias("_n")).withColumn("cut", F.floor(F.col("_n") * change))
    w = Window.partitionBy("series_id", "win_id").orderBy("pos")
    rows = sliding(samples, size, size - size // 2)
    rows = rows.withColumn("_turn", F.coalesce((F.signum("x") != F.lag(F.signum("x")).over(w)).cast("int"), F.lit(0)))
    v = rows.groupBy("series_id", "win_id").agg(measure.cast("double").alias("value")).join(n, "series_id")
    begin = F.col("win_id") * (size // 2)
    v = v.withColumns({"at": begin + size // 2, "_early": F.when(begin + size <= F.col("cut"), F.col("value"))})
    all_ = Window.partitionBy("series_id")
    if counts:
        # |value - mean| > k sigma, times the number of early windows: whole numbers, squared.
        m, total = F.count("_early").over(all_), F.sum("_early").over(all_)
        away = m * F.col("value") - total
        beyond = away * away > k * k * (m * F.sum(F.col("_early") * F.col("_early")).over(all_) - total * total)
        alarm = F.coalesce(beyond if two_sided else beyond & (away > 0), F.lit(False))
        value = F.col("value") / size
    else:
        away = F.col("value") - F.avg("_early").over(all_)
        alarm = F.coalesce((F.abs(away) if two_sided else away) > k * F.stddev_pop("_early").over(all_), F.lit(False))
        value = F.col("value")
    return v.withColumns({"alarm": alarm, "value": value}).select("series_id", "win_id", "at", "value", "alarm", (F.col("at") >= F.col("cut")).alias("after"), "cut", "_n")


def envelope_alarms(samples: DataFrame, change: float = 0.5, quantile: float = 0.995) -> DataFrame:
    """Samples whose envelope exceeds that quantile of the envelope before the change."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["x"].to_numpy()
        cut = int(len(x) * change)
        env = dsp.envelope(x)
        limit = np.quantile(dsp.envelope(x[:cut]), quantile) if cut else np.inf
        at = np.flatnonzero(env > limit)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "at": at, "value": env[at], "alarm": True, "after": at >= cut, "cut": cut, "_n": len(x)})

    return samples.groupBy("series_id").applyInPandas(run, "series_id long, at long, value double, alarm boolean, after boolean, cut long, _n long")


def _interval_counts(samples: DataFrame, fs: float, change: float, threshold: float = 2.5, drift: float = 0.5) -> DataFrame:
    """What CUSUM on the intervals in seconds finds, by intervals; no row for a series without one.

    The change's place among the intervals, and the latency in samples, go by the ratio of lengths.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["x"].to_numpy()
        intervals = np.diff(dsp.detect(x, fs)) / fs
        n, m, cut = len(x), len(intervals), int(len(x) * change)
        at = np.flatnonzero(recurrences.cusum(intervals, threshold, drift)[2])
        first = int(cut / n * m)
        after = at[at >= first]
        latency = int((after[0] - first) * (n / m)) if len(after) else n - cut
        row = (pdf["series_id"].iloc[0], len(after), len(at) - len(after), latency, first, m - first)
        return pd.DataFrame([row] if m else [], columns=["series_id", "tp", "fp", "latency", "neg", "pos"])

    return samples.groupBy("series_id").applyInPandas(run, "series_id long, tp long, fp long, latency long, neg long, pos long")


def compare_baselines(samples: DataFrame, size: int = 1024, change: float = 0.5, fs: float = 1.0) -> DataFrame:
    """Precision, recall, F1, false-positive rate and latency of the energy, zero-crossing and envelope detectors, by samples, and of CUSUM, by intervals."""
    parts = {"energy": energy_alarms(samples, size, change), "zcr": zcr_alarms(samples, size, change), "envelope": envelope_alarms(samples, change)}
    out = None
    for name, df in parts.items():
        one = df.select("series_id", F.lit(name).alias("method"), "at", "alarm", "after", "cut", "_n")
        out = one if out is None else out.unionByName(one)
    sizes = samples.groupBy("series_id").agg((F.max("idx") + 1).alias("_n"))
    counts = out.groupBy("series_id", "method").agg(
        F.count_if(F.col("alarm") & F.col("after")).alias("tp"), F.count_if(F.col("alarm") & ~F.col("after")).alias("fp"),
        F.min(F.when(F.col("alarm") & F.col("after"), F.col("at") - F.col("cut"))).alias("latency"),
    )
    counts = counts.join(sizes, "series_id").withColumn("neg", F.floor(F.col("_n") * change)).withColumn("pos", F.col("_n") - F.col("neg")).drop("_n")
    counts = counts.unionByName(_interval_counts(samples, fs, change).withColumn("method", F.lit("cusum")))
    return scored(counts).select("series_id", "method", "precision", "recall", "f1_score", "fpr", F.coalesce("latency", "pos").alias("latency_samples"))


__all__ = ["campaign_summary", "campaign_verdicts", "compare_baselines", "energy_alarms", "envelope_alarms", "segment_verdicts", "zcr_alarms"]
