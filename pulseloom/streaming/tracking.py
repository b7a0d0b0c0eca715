"""Stateful trackers over a stream of pulses.

State of a series survives micro-batches. Rows of a batch are put in order of
time; a row that is older than the last one of its series is late and dropped,
as its interval can't be undone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from pulseloom.sources.sinks import working_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, directory: str, files_per_batch: int = 1, pattern: str = "*.parquet", delay: str = "1 hour") -> DataFrame:
    """Pulses from a directory of event files, with a watermark: series_id, event_id, channel, ts, toa_s, peak_v."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(directory)
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D")
    out = raw.select(F.col("user_id").alias("series_id"), "event_id", F.col("event_type").alias("channel"), F.timestamp_micros((seconds * 1e6).cast("long")).alias("ts"), seconds.alias("toa_s"), F.col("value").alias("peak_v"))
    return out.withWatermark("ts", delay)


def _merged(frames: Iterator[pd.DataFrame], last: float | None) -> pd.DataFrame:
    pdf = pd.concat(list(frames)).sort_values(["toa_s", "event_id"])
    return pdf if last is None else pdf[pdf["toa_s"] >= last]


def delta_t(pulses: DataFrame) -> DataFrame:
    """Intervals to the pulse before, in append mode."""

    def run(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        pdf = _merged(frames, last)
        if not len(pdf):
            return
        before = np.concatenate(([np.nan if last is None else last], pdf["toa_s"].to_numpy()[:-1]))
        state.update((float(pdf["toa_s"].iloc[-1]),))
        out = pdf[["series_id", "event_id", "toa_s"]].assign(delta_t_s=pdf["toa_s"].to_numpy() - before)
        yield out[out["delta_t_s"].notna()]

    return pulses.groupBy("series_id").applyInPandasWithState(run, "series_id long, event_id long, toa_s double, delta_t_s double", "last double", "append", GroupStateTimeout.NoTimeout)


def trackers(pulses: DataFrame, q: float = 1e8, r: float = 1e8, p0: float = 1e8, gap: float = 60_000.0, alpha: float = 0.2, mu: float = 30_000.0, drift: float = 1_000.0, threshold: float = 100_000.0) -> DataFrame:
    """Kalman, EWMA and CUSUM updated interval by interval; CUSUM needs a given target, as the series' mean isn't known yet."""

    def run(key, frames, state: GroupState):
        last, n, x, p, s, up, down = state.get if state.exists else (None, 0, 0.0, p0, 0.0, 0.0, 0.0)
        rows = []
        for t, event in _merged(frames, last)[["toa_s", "event_id"]].itertuples(index=False):
            if last is not None:
                z = t - last
                if n == 0 or z > gap:
                    x, p = z, p0
                s = z if n == 0 else alpha * z + (1 - alpha) * s
                ahead = p + q
                gain = ahead / (ahead + r)
                score = (z - x) / np.sqrt(ahead + r)
                x, p = x + gain * (z - x), (1 - gain) * ahead
                if n:
                    up, down = max(0.0, up + z - mu - drift), max(0.0, down - z + mu - drift)
                n += 1
                rows.append((key[0], int(event), z, x, score, s, up, down, bool(up > threshold or down > threshold)))
            last = float(t)
        if last is not None:
            state.update((last, n, float(x), float(p), float(s), float(up), float(down)))
        if rows:
            yield pd.DataFrame(rows, columns=["series_id", "event_id", "delta_t_s", "kalman_filtered", "kalman_z", "ewma", "g_plus", "g_minus", "alarm"])

    schema = "series_id long, event_id long, delta_t_s double, kalman_filtered double, kalman_z double, ewma double, g_plus double, g_minus double, alarm boolean"
    return pulses.groupBy("series_id").applyInPandasWithState(run, schema, "last double, n long, x double, p double, s double, up double, down double", "append", GroupStateTimeout.NoTimeout)


def window_counts(pulses: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Pulses and their sum by channel and event-time window; rows behind the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = pulses.groupBy(w.alias("w"), "channel").agg(F.count("*").alias("n"), F.sum("peak_v").alias("total"))
    return out.select("channel", F.unix_seconds("w.start").alias("start_s"), "n", "total")


def sessions(pulses: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Bursts: pulses of a series with no pause longer than the gap."""
    out = pulses.groupBy(F.session_window("ts", gap).alias("w"), "series_id").agg(F.count("*").alias("n"))
    return out.select("series_id", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def simple_trackers(pulses: DataFrame, sma_rows: int = 10, order: int = 8, mu: float = 0.01, forgetting: float = 0.99, p0: float = 1000.0, bound: float = 10.0) -> DataFrame:
    """Moving average, LMS and RLS one-step predictions updated interval by interval; the first ``order`` intervals pass through.

    State of a series: its last time, the last intervals, and the predictors' weights.
    """

    def run(key, frames, state: GroupState):
        if state.exists:
            last, n, recent, seen, w_lms, w_rls, p = state.get
            recent, seen, w_lms, w_rls, p = list(recent), np.array(seen), np.array(w_lms), np.array(w_rls), np.array(p).reshape(order, order)
        else:
            last, n, recent, seen, w_lms, w_rls, p = None, 0, [], np.zeros(order), np.zeros(order), np.zeros(order), np.eye(order) * p0
        rows = []
        for t, event in _merged(frames, last)[["toa_s", "event_id"]].itertuples(index=False):
            if last is not None:
                z = t - last
                recent = [*recent, z][-max(sma_rows, 1):]
                lms = rls = z
                if n >= order:
                    seen = np.concatenate(([recent[-2]], seen[:-1]))
                    lms, rls = float(w_lms @ seen), float(w_rls @ seen)
                    w_lms = np.clip(w_lms + 2 * mu * (z - lms) * seen, -bound, bound)
                    k = p @ seen / (forgetting + seen @ p @ seen)
                    w_rls, p = w_rls + k * (z - rls), (p - np.outer(k, seen @ p)) / forgetting
                n += 1
                rows.append((key[0], int(event), z, float(np.mean(recent)), lms, rls))
            last = float(t)
        if last is not None:
            state.update((last, n, [float(v) for v in recent], seen.tolist(), w_lms.tolist(), w_rls.tolist(), p.ravel().tolist()))
        if rows:
            yield pd.DataFrame(rows, columns=["series_id", "event_id", "delta_t_s", "sma", "lms_prediction", "rls_prediction"])

    doubles = ", ".join(f"{c} array<double>" for c in ("recent", "seen", "w_lms", "w_rls", "p"))
    return pulses.groupBy("series_id").applyInPandasWithState(run, "series_id long, event_id long, delta_t_s double, sma double, lms_prediction double, rls_prediction double", f"last double, n long, {doubles}", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame], files_per_batch: int = 1, keys: tuple[str, ...] = (), pattern: str = "events.parquet*") -> DataFrame:
    """Run a streaming operator over the event files that are there, and return what it gave.

    Rows go to files in a shared folder, with a checkpoint. Without keys they are
    appended as they are final. With keys, updates of them are written batch by
    batch, and the last one of each counts; state behind the watermark goes.
    """
    out, folder = operator(source(spark, sf_dir, files_per_batch, pattern)), working_dir(spark)
    writer = out.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if keys:
        each = lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/rows/part={batch}")
        writer.outputMode("update").foreachBatch(each).start().awaitTermination()
    else:
        writer.outputMode("append").format("parquet").start(f"{folder}/rows").awaitTermination()
    if not keys:
        return spark.read.schema(out.schema).parquet(f"{folder}/rows")
    rows = spark.read.schema(StructType([*out.schema.fields, StructField("_batch", LongType())])).parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), "_batch").alias("v")).select(*keys, "v.*").select(*out.columns)


def without_repeats(pulses: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The first row of each key. A key is held until the watermark has passed its row, so repeats have to come within the watermark's delay."""
    return pulses.dropDuplicatesWithinWatermark(list(keys))


def stage_events(pulses: DataFrame, marks: DataFrame, within: str = "1 day", how: str = "inner") -> DataFrame:
    """Pulses with the marks of their series (series_id, ts, event_id) that came at most ``within`` before them, as both arrive.

    Both sides have a watermark, so a row is held only until no partner can
    come: a mark for ``within`` after the watermark, a pulse until the watermark
    has passed it. With how="left" a pulse without a mark is given then.
    """
    right = marks.select(F.col("series_id").alias("_series"), F.col("ts").alias("mark_ts"), F.col("event_id").alias("mark_id"))
    near = (F.col("series_id") == F.col("_series")) & (F.col("mark_ts") <= F.col("ts")) & (F.col("mark_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    out = pulses.join(right, near, how)
    return out.select("series_id", "event_id", "toa_s", "mark_id", (F.col("toa_s") - F.unix_micros("mark_ts") / F.lit(1e6)).alias("since_mark_s"))
