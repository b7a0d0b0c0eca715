"""Ordered trackers over intervals: CUSUM as window sums, recurrences as scans over blocks of series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import recurrences
from pulseloom.operators import scan


def cusum(intervals: DataFrame, value: str = "delta_t_s", threshold: float = 5.0, drift: float = 0.5, burnin: int = 200, mu_0: float | None = None) -> DataFrame:
    """Two-sided CUSUM g_plus, g_minus and alarms.

    The sum that is reset at 0 equals the running sum less its running minimum,
    so no row waits for another. The target is the mean of the first ``burnin``
    rows unless given; the first row never counts; alarms don't reset.
    """
    all_ = Window.partitionBy("series_id")
    to_here = all_.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    target = F.lit(mu_0) if mu_0 is not None else F.avg(F.when(F.col("k") < burnin, F.col(value))).over(all_)
    z = F.col(value) - F.col("_mu")
    rows = intervals.withColumn("_mu", target)
    rows = rows.withColumns({
        "_up": F.sum(F.when(F.col("k") > 0, z - drift).otherwise(0.0)).over(to_here),
        "_down": F.sum(F.when(F.col("k") > 0, -z - drift).otherwise(0.0)).over(to_here),
    })
    rows = rows.withColumns({"g_plus": F.col("_up") - F.min("_up").over(to_here), "g_minus": F.col("_down") - F.min("_down").over(to_here)})
    return rows.withColumn("alarm", (F.col("g_plus") > threshold) | (F.col("g_minus") > threshold)).drop("_mu", "_up", "_down")


def alarm_summary(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if("alarm").alias("n_alarms"), F.min(F.when(F.col("alarm"), F.col("k"))).alias("first_alarm"),
        F.max("g_plus").alias("max_g_plus"), F.max("g_minus").alias("max_g_minus"),
    )


def log_cusum(intervals: DataFrame, drift: float = 0.5) -> DataFrame:
    """Upper and lower (negative) sums of the z-scores of log10 intervals; a constant series has scale 1."""
    all_ = Window.partitionBy("series_id")
    to_here = all_.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    y = F.log10(F.greatest("delta_t_s", F.lit(1e-12)))
    rows = intervals.withColumn("log10_dt", y)
    s = F.stddev_pop("log10_dt").over(all_)
    rows = rows.withColumn("z", (F.col("log10_dt") - F.avg("log10_dt").over(all_)) / F.when(s == 0, 1.0).otherwise(s))
    rows = rows.withColumns({"_up": F.sum(F.col("z") - drift).over(to_here), "_down": F.sum(-F.col("z") - drift).over(to_here)})
    floor = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(to_here))
    return rows.withColumns({"c_plus": floor("_up"), "c_minus": -floor("_down")}).drop("_up", "_down")


def kalman(intervals: DataFrame, q: float = 7.4e-14, r: float = 1.85e-15, p0: float = 1e-12, gap: float = 10.0, x0: float | None = None) -> DataFrame:
    """Filtered intervals and z-scores of the innovations; an interval above ``gap`` starts the filter anew."""
    return scan.scan(intervals, [scan.Kalman(q, r, p0, gap, x0)])


def kalman_plain(intervals: DataFrame, q: float = 1e-5, r: float = 1e-2, p0: float = 1.0) -> DataFrame:
    out = kalman(intervals, q, r, p0, float("inf"))
    return out.select(*[c for c in out.columns if not c.startswith("kalman_") or c == "kalman_filtered"])


def ewma(intervals: DataFrame, alpha: float = 0.2) -> DataFrame:
    return scan.scan(intervals, [scan.Ewma(alpha=alpha)])


def log_ewma(intervals: DataFrame, alpha: float = 0.2, warmup: int = 50) -> DataFrame:
    """EWMA of the decimal logarithm of the intervals, begun at the median of the first ones."""
    rows = intervals.withColumn("log10_dt", F.log10(F.greatest("delta_t_s", F.lit(1e-12))))
    first = F.percentile(F.when(F.col("k") < warmup, F.col("log10_dt")), F.lit(0.5)).over(Window.partitionBy("series_id"))
    rows = rows.withColumn("_begun", F.when(F.col("k") == 0, first).otherwise(F.col("log10_dt")))
    return scan.scan(rows, [scan.Ewma("_begun", alpha, "log_ewma")]).drop("_begun")


def _weighed(intervals: DataFrame, alpha_0: float, low: float, high: float, rows: int, reference_variance: float | None) -> DataFrame:
    all_ = Window.partitionBy("series_id")
    local = F.var_pop("delta_t_s").over(all_.orderBy("k").rowsBetween(-(rows - 1), 0)) + 1e-30
    whole = (F.lit(reference_variance) if reference_variance is not None else F.var_pop("delta_t_s").over(all_)) + 1e-30
    return intervals.withColumn("alpha", F.least(F.lit(high), F.greatest(F.lit(low), alpha_0 * local / whole)))


def adaptive_ewma(intervals: DataFrame, alpha_0: float = 0.2, low: float = 0.05, high: float = 0.8, rows: int = 10, reference_variance: float | None = None) -> DataFrame:
    """EWMA whose weight follows the last rows' variance over the series' own, or over a given one where the whole series isn't known."""
    return scan.scan(_weighed(intervals, alpha_0, low, high, rows, reference_variance), [scan.Ewma(alpha="alpha")])


def lms(intervals: DataFrame, order: int = 8, mu: float = 0.01) -> DataFrame:
    return scan.whole(intervals, lambda z: recurrences.lms_predict(z, order, mu), ["lms_prediction", "lms_error"])


def rls(intervals: DataFrame, order: int = 8, forgetting: float = 0.99, p0: float = 1000.0) -> DataFrame:
    return scan.whole(intervals, lambda z: recurrences.rls_predict(z, order, forgetting, p0), ["rls_prediction", "rls_error"])


def unified(intervals: DataFrame, q: float = 7.4e-14, r: float = 1.85e-15, p0: float = 1e-12, gap: float = 10.0, threshold: float = 8.0, drift: float = 0.5, burnin: int = 200) -> DataFrame:
    """Kalman and adaptive EWMA on the intervals, in one pass over each series, and CUSUM on the Kalman z-scores."""
    both = scan.scan(_weighed(intervals, 0.2, 0.05, 0.8, 10, None), [scan.Ewma(alpha="alpha"), scan.Kalman(q, r, p0, gap)])
    return cusum(both, "kalman_z", threshold, drift, burnin)


def compare(intervals: DataFrame, algorithms: tuple[str, ...] = ("EWMA", "SMA", "Kalman", "LMS", "RLS"), more: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] | None = None) -> DataFrame:
    """Root mean square residual of each tracker: series_id, tracker, score. more: further trackers by name, and the column that each adds."""
    from pulseloom.operators.rolling import moving_average

    residual = lambda c: F.sqrt(F.avg(F.pow(F.col("delta_t_s") - F.col(c), F.lit(2.0)))).alias("score")
    known = {"EWMA": (ewma, "ewma"), "SMA": (moving_average, "sma"), "Kalman": (kalman_plain, "kalman_filtered"), "LMS": (lms, "lms_prediction"), "RLS": (rls, "rls_prediction")} | (more or {})
    out = None
    for name, (tracker, c) in ((n, known[n]) for n in (*algorithms, *(more or {}))):
        one = tracker(intervals).groupBy("series_id").agg(residual(c)).select("series_id", F.lit(name).alias("tracker"), "score")
        out = one if out is None else out.unionByName(one)
    return out
