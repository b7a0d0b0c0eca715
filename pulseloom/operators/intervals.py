"""Inter-pulse intervals: differences, labels, clustering, stitching, phase."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _series() -> Window:
    return Window.partitionBy("series_id").orderBy("k")


def delta_t(pulses: DataFrame) -> DataFrame:
    """Intervals in seconds; each belongs to the later of its two pulses. Series of one pulse give none."""
    gap = F.col("toa_s") - F.lag("toa_s").over(_series())
    return pulses.withColumn("delta_t_s", gap).filter("k > 0").withColumn("k", F.col("k") - 1)


def log_rate(intervals: DataFrame, least: float = 1e-12) -> DataFrame:
    """Decimal logarithm and reciprocal of the intervals, both of at least ``least`` seconds."""
    safe = F.greatest("delta_t_s", F.lit(least))
    return intervals.withColumns({"log10_dt": F.log10(safe), "pulse_rate_hz": 1 / safe})


def flag_outliers(intervals: DataFrame, max_valid_dt_s: float = 1.0) -> DataFrame:
    """is_outlier (interval strictly above the cut-off) and valid_dt (null for outliers)."""
    out = F.col("delta_t_s") > max_valid_dt_s
    return intervals.withColumns({"is_outlier": out, "valid_dt": F.when(~out, F.col("delta_t_s"))})


def first_arrivals(detections: DataFrame, min_distance: float, at: str = "idx") -> DataFrame:
    """Detections that begin a cluster: those further than min_distance behind the one before."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy("series_id").orderBy(at))
    return detections.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > min_distance)).drop("_gap")


def stitch(pulses: DataFrame, min_pulses: int = 2, partitions: int | None = None) -> DataFrame:
    """Intervals of a campaign of segments, with the dead time between consecutive segments.

    pulses: campaign, segment_id, trigger_epoch, t_s (within the segment).
    Segments with fewer pulses are dropped. Dead time is only known, and only
    kept, where the trigger is known and the time is positive. Only one row per
    segment goes through the campaign's ordering, in that many partitions (the
    session's without).
    """
    per = Window.partitionBy("campaign", "segment_id")
    kept = pulses.withColumn("_n", F.count("*").over(per)).filter(F.col("_n") >= min_pulses)
    local = kept.withColumn("_no", F.row_number().over(per.orderBy("t_s")) - 1).withColumn("delta_t_s", F.col("t_s") - F.lag("t_s").over(per.orderBy("t_s")))
    ends = kept.groupBy("campaign", "segment_id", "trigger_epoch").agg(F.min("t_s").alias("first"), F.max("t_s").alias("last"))
    if partitions:
        ends = ends.repartition(partitions, "campaign")
    order = Window.partitionBy("campaign").orderBy("trigger_epoch", "segment_id")
    dead = (F.col("trigger_epoch") + F.col("first")) - (F.lag("trigger_epoch").over(order) + F.lag("last").over(order))
    dead = ends.withColumn("delta_t_s", dead).filter("trigger_epoch > 0 AND delta_t_s > 0")
    names = ["campaign", "segment_id", "trigger_epoch", "part", "delta_t_s"]
    within = local.filter("_no > 0").withColumn("part", F.col("_no").cast("long"))
    return within.select(*names).unionByName(dead.withColumn("part", F.lit(0).cast("long")).select(*names))


def _angle(x: Column) -> Column:
    """Mean direction of doubled angles (radians) as an aggregate or window column."""
    return F.atan2(F.avg(F.sin(2 * x)), F.avg(F.cos(2 * x)))


def fold_phase(pulses: DataFrame, freq_hz: float, target_deg: float = 70.0) -> DataFrame:
    """Phase of each pulse in the grid's period, turned so that the two half-wave clusters sit at the target; and signed amplitude."""
    turned = F.pmod(F.col("toa_s"), F.lit(1.0 / freq_hz)) * freq_hz * 360.0
    angles = pulses.withColumn("_raw", turned)
    centre = angles.groupBy("series_id").agg((F.degrees(_angle(F.radians("_raw"))) / 2).alias("_centre"))
    phase = F.pmod(F.col("_raw") - F.col("_centre") + target_deg, F.lit(360.0))
    out = angles.join(centre, "series_id").withColumn("phase_deg", phase)
    return out.withColumn("signed_v", F.when(F.col("phase_deg").between(0, 180), F.col("peak_v")).otherwise(-F.col("peak_v"))).drop("_raw", "_centre")


def phase_inliers(phases: DataFrame, k_sigma: float = 2.5, least_mad: float = 5.0, at_least: int = 20) -> DataFrame:
    """Pulses near one of the two antipodal clusters: distance at most median + k * max(1.4826 MAD, 5 degrees); small series pass whole."""
    centre = phases.groupBy("series_id").agg((F.degrees(_angle(F.radians("phase_deg"))) / 2).alias("_c"), F.count("*").alias("_n"))
    part = F.pmod(F.col("phase_deg") - F.col("_c"), F.lit(180.0))
    near = phases.join(centre, "series_id").withColumn("cluster_distance", F.least(part, 180.0 - part))
    middle = near.groupBy("series_id").agg(F.percentile("cluster_distance", F.lit(0.5)).alias("_m"))
    near = near.join(middle, "series_id")
    mad = near.groupBy("series_id").agg(F.percentile(F.abs(F.col("cluster_distance") - F.col("_m")), F.lit(0.5)).alias("_mad"))
    limit = F.col("_m") + k_sigma * F.greatest(1.4826 * F.col("_mad"), F.lit(least_mad))
    return near.join(mad, "series_id").filter((F.col("cluster_distance") <= limit) | (F.col("_n") < at_least)).drop("_c", "_n", "_m", "_mad")


#: Frequencies of a block, which one row stands for, and of a row of the products within it.
_BLOCK, _INNER = 2000, 50


def _best_frequency(times: Broadcast, low: float, high: float, steps: int) -> DataFrame:
    """The frequency of an even grid with the longest mean of exp(i 4 pi f t), and that length; the lowest one of equal ones.

    exp(i 4 pi (f + g) t) is a product, so that a block of the grid is a product of two small matrices.
    """
    step = (high - low) / (steps - 1)

    def of(batches):
        t = times.value
        inner = np.exp(4j * np.pi * step * np.outer(t, np.arange(_INNER)))
        for batch in batches:
            freqs, lengths = [], []
            for at in batch.column(0).to_pylist():
                first = np.arange(at * _BLOCK, min((at + 1) * _BLOCK, steps), _INNER)
                found = np.abs(np.exp(4j * np.pi * np.outer(low + first * step, t)) @ inner).ravel()[: steps - first[0]] / len(t)
                k = int(found.argmax())
                freqs.append(low + (int(first[0]) + k) * step)
                lengths.append(float(found[k]))
            yield pa.RecordBatch.from_arrays([pa.array(freqs, pa.float64()), pa.array(lengths, pa.float64())], ["freq_hz", "resultant"])

    blocks = SparkSession.active().range(-(-steps // _BLOCK))
    return blocks.mapInArrow(of, "freq_hz double, resultant double").orderBy(F.desc("resultant"), "freq_hz").limit(1)


def resultants(pulses: DataFrame, frequencies: DataFrame) -> DataFrame:
    """frequencies (freq_hz and further columns; a bounded grid) with the length of the mean of exp(i 4 pi f t) over all pulses."""
    doubled = 4 * math.pi * F.col("freq_hz") * F.col("toa_s")
    rows = pulses.select("toa_s").crossJoin(F.broadcast(frequencies.select("freq_hz").distinct()))
    means = rows.groupBy("freq_hz").agg(F.avg(F.cos(doubled)).alias("_c"), F.avg(F.sin(doubled)).alias("_s"))
    return frequencies.join(means, "freq_hz").withColumn("resultant", F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))).drop("_c", "_s")


def grid_frequency(pulses: DataFrame, base: float = 50.0, width: float = 0.5, coarse: int = 200_000, fine: int = 100_000, near: float = 0.01, sample: int = 10_000, seed: int = 1) -> DataFrame:
    """The frequency at which doubled phases agree best: a coarse grid, then a fine one about its best point.

    With fewer than ten pulses the base is returned. More than ``sample`` pulses
    are sampled by a seeded hash; so a bounded number of times is broadcast. Of
    equal resultants the lowest frequency wins.
    """
    spark = pulses.sparkSession
    some = pulses.select("toa_s").orderBy(F.xxhash64(F.lit(seed), "toa_s")).limit(sample).collect()
    n = len(some)
    if n < 10:
        return spark.createDataFrame([(float(base), None, n)], "freq_hz double, resultant double, n long")
    times = spark.sparkContext.broadcast(np.array([r["toa_s"] for r in some]))
    first = _best_frequency(times, base - width, base + width, coarse).first()["freq_hz"]
    return _best_frequency(times, first - near, first + near, fine).withColumn("n", F.lit(n).cast("long"))
