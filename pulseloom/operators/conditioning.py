"""Conditioning of sampled waveforms in long form (series_id, idx, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _all() -> Window:
    return Window.partitionBy("series_id")


def drop_nan(samples: DataFrame) -> DataFrame:
    """Samples that are numbers, numbered anew."""
    w = Window.partitionBy("series_id").orderBy("idx")
    kept = samples.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return kept.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def center(samples: DataFrame) -> DataFrame:
    return samples.withColumn("x", F.col("x") - F.avg("x").over(_all()))


def center_maxabs(samples: DataFrame) -> DataFrame:
    """Mean 0 and largest magnitude 1; a constant series stays 0."""
    c = center(samples).withColumn("_m", F.max(F.abs("x")).over(_all()))
    return c.withColumn("x", F.when(F.col("_m") == 0, F.col("x")).otherwise(F.try_divide("x", "_m"))).drop("_m")


def normalize(samples: DataFrame, method: str = "zscore") -> DataFrame:
    """zscore, minmax or robust (median and 1.4826 MAD); a scale of 0 only shifts."""
    if method == "zscore":
        s = samples.withColumns({"_s": F.stddev_pop("x").over(_all()), "_c": F.avg("x").over(_all())})
    elif method == "minmax":
        s = samples.withColumns({"_s": F.max("x").over(_all()) - F.min("x").over(_all()), "_c": F.min("x").over(_all())})
    elif method == "robust":
        middle = samples.groupBy("series_id").agg(F.percentile("x", F.lit(0.5)).alias("_c"))
        s = samples.join(middle, "series_id")
        spread = s.groupBy("series_id").agg((1.4826 * F.percentile(F.abs(F.col("x") - F.col("_c")), F.lit(0.5))).alias("_s"))
        s = s.join(spread, "series_id")
    else:
        raise ValueError(f"unknown method {method!r}")
    shifted = F.col("x") - F.col("_c")
    return s.withColumn("x", F.when(F.col("_s") == 0, shifted).otherwise(F.try_divide(shifted, F.col("_s")))).drop("_s", "_c")


def baseline_zscore(samples: DataFrame, baseline: int) -> DataFrame:
    """z-scores by the first ``baseline`` samples; unchanged if there are no more than that, or none is asked for."""
    if baseline <= 0:
        return samples
    early = F.when(F.col("idx") < baseline, F.col("x"))
    s = samples.withColumns({"_m": F.avg(early).over(_all()), "_s": F.stddev_pop(early).over(_all()), "_n": F.count("*").over(_all())})
    z = (F.col("x") - F.col("_m")) / (F.col("_s") + 1e-12)
    return s.withColumn("x", F.when(F.col("_n") <= baseline, F.col("x")).otherwise(z)).drop("_m", "_s", "_n")


def rmse(reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """Root mean square difference of two sets of series, aligned by index."""
    both = reference.select("series_id", "idx", F.col("x").alias("a")).join(estimate.select("series_id", "idx", F.col("x").alias("b")), ["series_id", "idx"])
    return both.groupBy("series_id").agg(F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2.0)))).alias("rmse"))
