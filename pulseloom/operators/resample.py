"""Poisson bootstrap of quantiles: each row counts a Poisson(1) number of times in each resample.

A resample of n rows has a Poisson(n) number of rows, which are drawn from them
uniformly. Its quantile is one of these by rank, and the place of a rank among
so many uniform numbers is a beta number: two numbers are drawn for a resample,
however many rows there are, and its value is that of the row in this place.
Only the values near the quantile are told apart: those of ranks within
SIGMAS deviations of the quantile's rank in a resample, some multiple of the
root of a series' rows. They come from exact ranks (``quantiles``), and their
counts are partial sums, so that a series of all rows spreads over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators import quantiles

#: Deviations of the rank around which values are told apart; series up to SMALL rows are taken whole; draws that a task holds; series of a task.
SIGMAS, SMALL, DRAWS, SERIES = 6.0, 100_000, 1 << 17, 2_000


def _clipped(values: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """series_id, v, m: counts of the values near the quantile, and of all below (-inf) and above (inf)."""
    large = sizes.filter(F.col("n") > SMALL)
    n_large = large.count()
    if not n_large:
        return values.groupBy("series_id", "v").agg(F.count("*").alias("m"))
    half = F.ceil(SIGMAS * F.sqrt(F.col("n") * share * (1 - share))) + 2
    spots = large.select("series_id", "n", (F.col("n") * share).alias("_s"), half.alias("_h"))
    low, high = F.greatest(F.lit(0), F.floor(F.col("_s") - F.col("_h"))).cast("long"), F.least(F.col("n") - 1, F.ceil(F.col("_s") + F.col("_h"))).cast("long")
    ends = quantiles.written(spots.select("series_id", "n", low.alias("_a"), high.alias("_b")), "ends")
    ranks = ends.select(F.col("series_id").alias("g"), "n", F.explode(F.array("_a", "_b")).alias("rank")).distinct()
    chosen = F.broadcast(large) if n_large <= quantiles.TARGETS else large
    found = quantiles.at_ranks(values.join(chosen, "series_id", "left_semi").withColumnRenamed("series_id", "g"), ranks)
    limits = quantiles.written(found.groupBy(F.col("g").alias("series_id")).agg(F.min("v").alias("_low"), F.max("v").alias("_high")), "limits")
    near = values.join(F.broadcast(limits) if n_large <= quantiles.TARGETS else limits, "series_id", "left")
    v = F.when(F.col("v") < F.col("_low"), float("-inf")).when(F.col("v") > F.col("_high"), float("inf")).otherwise(F.col("v"))
    return near.select("series_id", v.alias("v")).groupBy("series_id", "v").agg(F.count("*").alias("m"))


def _percentiles(v: np.ndarray, times: np.ndarray, shares: list[float]) -> np.ndarray:
    """Percentiles, interpolated between neighbouring ranks, of ordered values that occur so many times; none of no values."""
    upto = np.cumsum(times)
    if not upto[-1]:
        return np.array([])
    spot = np.array(shares) * (upto[-1] - 1)
    low, high = (v[np.searchsorted(upto, f(spot), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (spot - np.floor(spot))


def poisson_bootstrap(values: DataFrame, value: str, share: float = 0.5, resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of a quantile of each series by seeded resampling: series_id (long), n, estimate, ci_low, ci_high.

    A resample's quantile is the first value at which its rows reach the share
    of them. Nulls, NaNs and infinite values are left out, and a series without
    any other has no row. An empty resample has no quantile and is left out
    (it has a chance of exp(-n)); a series of one row gives its value.
    """
    v = F.col(value).cast("double")
    kept = values.select("series_id", v.alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col("series_id").isNotNull())
    kept = quantiles.written(kept, "values")
    sizes = quantiles.written(kept.groupBy("series_id").agg(F.count("*").alias("n")), "sizes")
    n_series = sizes.count()
    parts = max(-(-n_series // SERIES), int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = _clipped(kept, sizes, share).repartition(parts, "series_id")

    def draw(table: pa.Table) -> pa.Table:
        sid = table["series_id"][0].as_py()
        order = np.argsort(table["v"].to_numpy(), kind="stable")
        v, upto = table["v"].to_numpy()[order], np.cumsum(table["m"].to_numpy()[order])
        r = np.random.default_rng([seed, sid & 0xFFFFFFFFFFFFFFFF])
        times, n = np.zeros(len(v), np.int64), upto[-1]
        for at in range(0, resamples, DRAWS):
            rows = r.poisson(n, min(DRAWS, resamples - at))
            rows = rows[rows > 0]
            rank = np.maximum(1, np.ceil(share * rows))
            # The rank-th of so many places drawn uniformly: it falls on a row of the first value that reaches it.
            place = r.beta(rank, rows - rank + 1) * n
            times += np.bincount(np.minimum(np.searchsorted(upto, place), len(v) - 1), minlength=len(v))
        # A rank beyond the told values counts as the outermost one of them: it lies outside of any interval.
        first, last = int(v[0] == -np.inf), len(v) - 1 - int(v[-1] == np.inf)
        ends = _percentiles(v[np.clip(np.arange(len(v)), first, last)], times, [(1 - level) / 2, (1 + level) / 2])
        return pa.table({"series_id": pa.array([sid] * len(ends[:1]), pa.int64()), "ci_low": ends[:1], "ci_high": ends[1:]})

    spread = counts.groupBy("series_id").applyInArrow(draw, "series_id long, ci_low double, ci_high double")
    whole = quantiles.group_quantiles(kept, "series_id", "v", {"estimate": share})
    return sizes.join(whole, "series_id").join(spread, "series_id", "left").select("series_id", "n", "estimate", "ci_low", "ci_high")
