"""Hypothesis tests: statistics as aggregates by series, distribution functions on the small results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.special import chi2_ppf, chi2_sf, kolmogorov_sf, normal_cdf
from pulseloom.operators.ranks import mann_whitney, two_sample_ks

__all__ = ["adf", "adf_sums", "bootstrap", "cohens_d", "kruskal", "ljung_box", "mann_whitney", "nis", "report", "two_sample_ks"]


def _scalar(function, kind: str = "double"):
    """A pandas UDF of a function of scalars; for results of one row per series."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else function(x, y) for x, y in zip(a, b)])

    return run


def nis(tracked: DataFrame, innovation: str = "kalman_innovation", variance: str = "kalman_variance", alpha: float = 0.05) -> DataFrame:
    """Normalised innovations squared: their mean, its chi-square bounds, and the Kolmogorov distance from chi-square with one degree."""
    w = Window.partitionBy("series_id")
    rows = tracked.select("series_id", (F.col(innovation) * F.col(innovation) / F.greatest(F.col(variance), F.lit(1e-30))).alias("nis"))
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy("nis")), "_n": F.count("*").over(w)})

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erf(math.sqrt(v / 2)))

    rows = rows.withColumn("_f", cdf("nis"))
    d = F.max(F.greatest(F.col("_i") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_i") - 1) / F.col("_n")))
    m = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("nis").alias("mean_nis"), d.alias("ks_distance"))
    m = m.withColumn("p_value", _scalar(lambda x, n: kolmogorov_sf(x, int(n)))("ks_distance", "n"))
    return m.withColumns({"chi2_low": F.lit(chi2_ppf(alpha / 2, 1)), "chi2_high": F.lit(chi2_ppf(1 - alpha / 2, 1)), "consistent": F.col("p_value") > alpha})


def ljung_box(values: DataFrame, value: str, lags: int = 20, order: str = "k", alpha: float = 0.05) -> DataFrame:
    """Portmanteau statistic over the first lags (a quarter of the rows if the series is shorter); a constant series is white."""
    w = Window.partitionBy("series_id").orderBy(order)
    rows = values.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy("series_id")))
    rows = rows.withColumns({f"_l{j}": F.col("_x") * F.lag("_x", j).over(w) for j in range(1, lags + 1)})
    sums = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_s"), *[F.coalesce(F.sum(f"_l{j}"), F.lit(0.0)).alias(f"_l{j}") for j in range(1, lags + 1)])
    used = F.when(F.col("n") < lags + 1, F.greatest(F.lit(1), F.floor(F.col("n") / 4))).otherwise(lags)
    sums = sums.withColumn("lags", used.cast("int"))
    flat = F.col("_s") / F.col("n") < 1e-30
    terms = [F.when(F.lit(j) <= F.col("lags"), F.try_divide(F.pow(F.try_divide(F.col(f"_l{j}"), F.col("_s")), F.lit(2.0)), F.col("n") - j)).otherwise(0.0) for j in range(1, lags + 1)]
    q = F.when(flat, 0.0).otherwise(F.col("n") * (F.col("n") + 2) * sum(terms[1:], terms[0]))
    out = sums.withColumn("q", q).withColumn("p_value", F.when(F.col("q") == 0, 1.0).otherwise(_scalar(lambda x, k: chi2_sf(x, int(k)))("q", "lags")))
    return out.select("series_id", "n", "lags", "q", "p_value", (F.col("p_value") > alpha).alias("white"))


def _ranks(values: DataFrame, value: str, over: list[str]) -> DataFrame:
    """Average ranks within ``over``; ties share theirs."""
    same = Window.partitionBy(*over, value)
    first = F.rank().over(Window.partitionBy(*over).orderBy(value))
    return values.withColumn("_ties", F.count("*").over(same)).withColumn("_rank", first + (F.col("_ties") - 1) / 2)


def kruskal(values: DataFrame, value: str, group: str, over: str) -> DataFrame:
    """H with tie correction, p-value and eta squared over groups of two or more rows; fewer than two groups are trivial."""
    kept = values.withColumn("_g", F.count("*").over(Window.partitionBy(over, group))).filter("_g >= 2")
    ranked = _ranks(kept, value, [over])
    ties = ranked.groupBy(over).agg((F.sum(F.col("_ties") * F.col("_ties")) - F.count("*")).cast("double").alias("_t"))
    sums = ranked.groupBy(over, group).agg(F.sum("_rank").alias("_r"), F.count("*").alias("_n"))
    m = sums.groupBy(over).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_rr"), F.sum("_n").alias("n"), F.count("*").alias("groups")).join(ties, over)
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1)) / F.nullif(1 - F.col("_t") / (n * n * n - n), F.lit(0.0))
    m = m.withColumn("h", F.when(F.col("groups") < 2, 0.0).otherwise(F.coalesce(h, F.lit(0.0))))
    m = m.withColumn("p_value", F.when(F.col("groups") < 2, 1.0).otherwise(_scalar(lambda x, k: chi2_sf(x, int(k) - 1) if k > 1 else 1.0)("h", "groups")))
    eta = F.greatest(F.lit(0.0), F.try_divide(F.col("h") - F.col("groups") + 1, n - F.col("groups")))
    return m.select(over, "groups", "n", "h", "p_value", F.coalesce(eta, F.lit(0.0)).alias("eta_squared"))


def cohens_d(values: DataFrame, value: str, first, by: str = "series_id") -> DataFrame:
    """Difference of the means of rows where ``first`` holds and of the others over their pooled deviation; 0 without any."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    m = values.groupBy(by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("_m1"), F.avg(b).alias("_m2"), F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2"), F.col("n1") + F.col("n2") - 2))
    d = F.when((F.col("n1") >= 2) & (F.col("n2") >= 2) & (pooled >= 1e-30), F.try_divide(F.col("_m1") - F.col("_m2"), pooled)).otherwise(0.0)
    return m.select(by, "n1", "n2", d.alias("cohens_d"))


def adf_lags(n: int) -> int:
    """Lags that are tried on a series of n rows."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), (n - 1) // 3))


def adf_sums(values: DataFrame, value: str, order: str = "k", lags: int = 10) -> DataFrame:
    """What the regressions of up to ``lags`` lags need of a series, as sums of products of lagged columns.

    n rows; x is a row less the series' mean, d the difference to the next row.
    dd[j] is the sum of d times d j rows earlier, xd[j] of x times it; x, xx and d are sums.
    """
    w = Window.partitionBy("series_id").orderBy(order)
    rows = values.select("series_id", order, (F.col(value) - F.avg(value).over(Window.partitionBy("series_id"))).alias("_x"))
    rows = rows.withColumn("_d", F.lead("_x").over(w) - F.col("_x"))
    past = [F.col("_d"), *(F.lag("_d", j).over(w) for j in range(1, lags + 1))]
    rows = rows.withColumns({f"_p{j}": c for j, c in enumerate(past)}).withColumn("_n", F.count("*").over(Window.partitionBy("series_id"))).withColumn("_i", F.row_number().over(w) - 1)
    real = F.col("_d").isNotNull()
    sums = lambda c: F.array(*[F.coalesce(F.sum(F.when(real, F.col(c) * F.col(f"_p{j}"))), F.lit(0.0)) for j in range(lags + 1)])
    # The rows at both ends, which regressions of fewer lags have and others don't; there are 2 * lags of them.
    edge = F.when(real & ((F.col("_i") < lags) | (F.col("_i") >= F.col("_n") - 1 - lags)), F.struct("_i", "_x", "_d"))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum(F.when(real, F.col("_x"))).alias("x"), F.sum(F.when(real, F.col("_x") * F.col("_x"))).alias("xx"), F.sum("_d").alias("d"),
        sums("_d").alias("dd"), sums("_x").alias("xd"), F.array_sort(F.collect_list(edge)).alias("edges"),
    )


def _normal_equations(row: dict, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """X'X, X'y and y'y of the regression with p lags, on all rows that have them: columns level, constant, lagged differences."""
    m, dd, xd = int(row["n"]) - 1, row["dd"], row["xd"]
    x = {e["_i"]: e["_x"] for e in row["edges"]}
    d = {e["_i"]: e["_d"] for e in row["edges"]}

    def lagged(i: int, j: int) -> float:
        """Sum of d i rows earlier times d j rows earlier, i <= j."""
        k = j - i
        return dd[k] - sum(d[u] * d[u - k] for u in range(k, p - i)) - sum(d[u] * d[u - k] for u in range(m - i, m))

    size = p + 2
    gram, right = np.zeros((size, size)), np.zeros(size)
    gram[0, 0] = row["xx"] - sum(x[u] ** 2 for u in range(p))
    gram[0, 1] = row["x"] - sum(x[u] for u in range(p))
    gram[1, 1] = m - p
    shifted = [row["d"] - sum(d[u] for u in range(p - j)) - sum(d[u] for u in range(m - j, m)) for j in range(p + 1)]
    level = [xd[j] - sum(x[u] * d[u - j] for u in range(j, p)) for j in range(p + 1)]
    right[0], right[1] = level[0], shifted[0]
    for j in range(1, p + 1):
        gram[0, j + 1], gram[1, j + 1], right[j + 1] = level[j], shifted[j], lagged(0, j)
        for i in range(1, j + 1):
            gram[i + 1, j + 1] = lagged(i, j)
    return np.triu(gram) + np.triu(gram, 1).T, right, lagged(0, 0)


def adf_statistic(row: dict) -> tuple[int, float, float]:
    """(lags by AIC, t statistic, bucketed p-value) from the sums of a series."""
    n = int(row["n"])
    if n < 20:
        return 0, 0.0, 1.0
    best = None
    for p in range(adf_lags(n) + 1):
        rows = n - 1 - p
        if rows < p + 2:
            continue
        gram, right, total = _normal_equations(row, p)
        inverse = np.linalg.pinv(gram, hermitian=True)
        beta = inverse @ right
        sse = max(0.0, float(total - beta @ right))
        aic = rows * math.log(sse / rows + 1e-30) + 2 * (p + 2)
        if best is None or aic < best[0]:
            error = math.sqrt(max(0.0, sse / max(1, rows - p - 2) * inverse[0, 0]))
            best = aic, p, float(beta[0] / error) if error > 1e-30 else 0.0
    t = best[2]
    for limit, p_value in ((-3.43, 0.005), (-2.86, 0.03), (-2.57, 0.07), (-1.95, 0.15)):
        if t < limit:
            return best[1], t, p_value
    return best[1], t, min(1.0, 0.5 + 0.5 * (1 - normal_cdf(abs(t))))


def adf(values: DataFrame, value: str, order: str = "k", alpha: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; fewer than 20 rows are trivial. Rows are summed where they lie; a row for each series is solved."""
    longest = values.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    sums = adf_sums(values, value, order, adf_lags(longest))

    def solve(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [adf_statistic(r) for r in rows]
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[2] < alpha for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), *columns], ["series_id", "lags", "statistic", "p_value", "stationary"])

    return sums.mapInArrow(solve, "series_id long, lags int, statistic double, p_value double, stationary boolean")


def iqr(x: np.ndarray) -> float:
    return float(np.subtract(*np.percentile(x, [75, 25])))


def mean_rate(x: np.ndarray) -> float:
    return float(np.mean(1 / x))


#: Statistics that are weighted sums of quantiles (share: weight), and those that are means of a function of each value.
_BY_RANK = {np.median: {0.5: 1.0}, iqr: {0.25: -1.0, 0.75: 1.0}}
_MEANS = {np.mean: np.asarray, mean_rate: np.reciprocal}


def resampled_quantiles(x: np.ndarray, shares: list[float], resamples: int, r: np.random.Generator) -> np.ndarray:
    """Quantiles (by linear interpolation) of resamples with replacement of the sorted x; a row each.

    The places that a resample draws are floor(n U) of n uniform numbers, so that its ordered values lie
    at the ordered numbers, which are sums of exponential gaps over the sum of all of them. Those of the
    ranks that the quantiles need are drawn together, by sums of gaps: work doesn't grow with n.
    """
    n = len(x)
    at = np.asarray(shares) * (n - 1)
    low = np.floor(at).astype(int)
    ranks = np.unique(np.concatenate([low, np.minimum(low + 1, n - 1)]))
    gaps = np.diff(np.concatenate([[-1], ranks, [n]]))
    sums = np.cumsum(r.standard_gamma(gaps, (resamples, len(gaps))), axis=1)
    drawn = x[np.minimum((n * (sums[:, :-1] / sums[:, -1:])).astype(int), n - 1)]
    a, b = drawn[:, np.searchsorted(ranks, low)], drawn[:, np.searchsorted(ranks, np.minimum(low + 1, n - 1))]
    with np.errstate(invalid="ignore"):
        return np.where((a == b) | (at == low), a, a + (b - a) * (at - low))


#: Values that are drawn at once.
_DRAWN = 1 << 18


def _resampled(x: np.ndarray, statistic, resamples: int, r: np.random.Generator) -> np.ndarray:
    """The statistic of each resample of the sorted x."""
    n = len(x)
    if statistic in _BY_RANK:
        weights = _BY_RANK[statistic]
        return resampled_quantiles(x, list(weights), resamples, r) @ np.array(list(weights.values()))
    y = _MEANS[statistic](x) if statistic in _MEANS else x
    step, kind = max(1, _DRAWN // n), np.uint16 if n <= 1 << 16 else np.int64
    found = []
    for at in range(0, resamples, step):
        drawn = y[r.integers(0, n, (min(step, resamples - at), n), kind)]
        found.append(drawn.mean(axis=1) if statistic in _MEANS else np.apply_along_axis(statistic, 1, drawn))
    return np.concatenate(found)


def _intervals(values: DataFrame, value: str, statistics: dict, resamples: int, level: float, seeds: list[int]) -> DataFrame:
    """series_id, and estimate, ci_low and ci_high of each statistic with its name before them; a series goes to Python once."""

    def run(table: pa.Table) -> pa.Table:
        sid = table["series_id"][0].as_py()
        x = np.sort(table[value].cast(pa.float64()).to_numpy())
        row = {"series_id": sid}
        for (name, statistic), seed in zip(statistics.items(), seeds):
            r = np.random.default_rng([seed, sid & 0x7FFFFFFF])
            # A value that is no number (they are sorted to the end) leaves no interval.
            found = [np.nan] if np.isnan(x[-1]) else _resampled(x, statistic, resamples, r)
            low, high = np.percentile(found, [50 * (1 - level), 100 - 50 * (1 - level)])
            row |= {f"{name}estimate": float(statistic(x)), f"{name}ci_low": float(low), f"{name}ci_high": float(high)}
        return pa.Table.from_pylist([row])

    columns = ", ".join(f"{n}{c} double" for n in statistics for c in ("estimate", "ci_low", "ci_high"))
    return values.select("series_id", value).groupBy("series_id").applyInArrow(run, f"series_id long, {columns}")


def bootstrap(values: DataFrame, value: str, statistic=np.median, resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of a statistic of each series, by seeded resampling in blocks of bounded memory.

    Medians and quartile ranges (``iqr``) of resamples come from their ranks, means and mean rates from
    sums; any other statistic is called for each resample.
    """
    return _intervals(values, value, {"": statistic}, resamples, level, [seed])


def report(tracked: DataFrame, max_dt: float = 1.0, segments: str = "segment", resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row per series: consistency, whiteness, stationarity of log10 intervals, group differences, intervals of median, IQR and mean rate."""
    kept = tracked.filter((F.col("delta_t_s") <= max_dt) & (F.col("delta_t_s") > 0))
    logs = kept.withColumn("log10_dt", F.log10("delta_t_s"))
    many = kept.withColumn("_n", F.count("*").over(Window.partitionBy("series_id"))).filter("_n >= 10")
    pre = lambda df, p: df.select("series_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "series_id"])
    parts = [
        pre(nis(tracked), "nis"), pre(ljung_box(tracked, "kalman_innovation"), "lb"), pre(adf(logs, "log10_dt"), "adf"),
        pre(kruskal(kept, "delta_t_s", segments, "series_id"), "kw"),
        _intervals(many, "delta_t_s", {"median_": np.median, "iqr_": iqr, "rate_": mean_rate}, resamples, 0.95, [seed, seed + 1, seed + 2]),
    ]
    out = tracked.select("series_id").distinct()
    for p in parts:
        out = out.join(p, "series_id", "left")
    return out
