"""Statistics over the last events of a series, with a least number of valid ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(rows: int, order: str = "k", by: str = "series_id") -> Window:
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(rows - 1), 0)


def _least(rows: int) -> int:
    return max(5, rows // 5)


def rolling_rates(flagged: DataFrame, rows: int = 50) -> DataFrame:
    """Mean rate, median, quartile range, 90 % quantile and coefficient of variation of valid intervals.

    Outliers (valid_dt null) take places in the frame but don't count. All
    columns share one window, so one sort serves them.
    """
    f, v = frame(rows), F.col("valid_dt")
    enough = F.count(v).over(f) >= _least(rows)
    q = lambda p: F.percentile(v, F.lit(p)).over(f)
    return flagged.withColumns({
        "rolling_rate_hz": F.when(enough, F.avg(1 / v).over(f)),
        "rolling_median_dt": F.when(enough, q(0.5)),
        "rolling_iqr_dt": F.when(enough, q(0.75) - q(0.25)),
        "rolling_p90_dt": F.when(enough, q(0.9)),
        "rolling_cv_dt": F.when(enough, F.try_divide(F.stddev_samp(v).over(f), F.avg(v).over(f))),
    })


def quantile_band(intervals: DataFrame, rows: int = 25, least: int = 5, low: float = 0.25, high: float = 0.75) -> DataFrame:
    f, v = frame(rows), F.col("delta_t_s")
    enough = F.count(v).over(f) >= least
    return intervals.withColumns({"band_low": F.when(enough, F.percentile(v, F.lit(low)).over(f)), "band_high": F.when(enough, F.percentile(v, F.lit(high)).over(f))})


def burstiness(flagged: DataFrame, rows: int = 50, least: int | None = None) -> DataFrame:
    """(sigma - mu) / (sigma + mu) of the frame; null while it has too few rows or any masked one."""
    f, v = frame(rows), F.col("valid_dt")
    s, m, n = F.stddev_pop(v).over(f), F.avg(v).over(f), F.count("*").over(f)
    whole = (n >= (_least(rows) if least is None else least)) & (F.count(v).over(f) == n)
    return flagged.withColumn("rolling_burstiness", F.when(whole, F.try_divide(s - m, s + m)))


def moving_average(intervals: DataFrame, rows: int = 10, value: str = "delta_t_s") -> DataFrame:
    return intervals.withColumn("sma", F.avg(value).over(frame(rows)))


def cumulative_time(intervals: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return intervals.withColumn("elapsed_s", F.sum("delta_t_s").over(w))


def weibull(flagged: DataFrame, rows: int = 50, least: int | None = None) -> DataFrame:
    """Shape and scale of the maximum-likelihood Weibull distribution (location 0) of the frame's positive valid intervals."""
    from pulseloom.functions.special import weibull_fit_udf

    f = frame(rows)
    least = _least(rows) if least is None else least
    frames = flagged.withColumn("_v", F.collect_list(F.when(F.col("valid_dt") > 0, F.col("valid_dt"))).over(f))
    fit = F.when(F.size("_v") >= least, weibull_fit_udf("_v"))
    return frames.withColumn("_fit", fit).withColumns({"weibull_beta": F.col("_fit.beta"), "weibull_eta": F.col("_fit.eta")}).drop("_v", "_fit")


def window_ids(intervals: DataFrame, size: int) -> DataFrame:
    return intervals.withColumn("window_id", F.floor(F.col("k") / size))


def stages(intervals: DataFrame, boundaries: list[float], time: str = "toa_s") -> DataFrame:
    """1 plus the number of ascending boundaries that lie before."""
    return intervals.withColumn("stage", sum([(F.col(time) > b).cast("int") for b in sorted(boundaries)], F.lit(1)))


def auto_stages(intervals: DataFrame, time: str = "toa_s", shares: tuple[float, ...] = (0.33, 0.66)) -> DataFrame:
    """Stages at fixed shares of each series' time span."""
    span = intervals.groupBy("series_id").agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    joined = intervals.join(span, "series_id")
    bound: list[Column] = [F.col("_t0") + s * (F.col("_t1") - F.col("_t0")) for s in shares]
    return joined.withColumn("stage", sum([(F.col(time) > b).cast("int") for b in bound], F.lit(1))).drop("_t0", "_t1")


def stage_changes(staged: DataFrame) -> DataFrame:
    """Rows whose stage is not that of the row before."""
    before = F.lag("stage").over(Window.partitionBy("series_id").orderBy("k"))
    return staged.withColumn("previous_stage", before).filter(F.col("stage") != F.col("previous_stage"))
