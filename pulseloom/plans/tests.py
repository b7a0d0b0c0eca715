"""Hypothesis tests as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.operators import hypothesis, intervals, track
from pulseloom.plans.catalog import register
from pulseloom.plans.common import chi2_tail, normal_tail, r, rounded
from pulseloom.plans.intervals import _KALMAN, GAP, P0, Q, R
from pulseloom.sources.tables import INTERVALS_SQL, pulses, read

_WITH = f"WITH {INTERVALS_SQL}"


def _dt(spark, d):
    return intervals.delta_t(pulses(spark, d))


@register(
    "nis_mean",
    f"{_KALMAN} SELECT series_id, count(*) AS n, {r('avg(innovation * innovation / greatest(variance, 1e-30))', 'mean_nis', 0)} FROM filtered GROUP BY series_id",
)
def nis_mean(spark, d):
    out = hypothesis.nis(track.kalman(_dt(spark, d), Q, R, P0, GAP))
    return rounded(out.select("series_id", "n", "mean_nis"), 0)


@register("nis_test")
def nis_test(spark, d):
    return hypothesis.nis(track.kalman(_dt(spark, d), 1e8, 1e8, 1e8, 1e12))


_LAGS = 10


@register(
    "ljung_box",
    f"""{_WITH}, c AS (SELECT series_id, k, delta_t_s - avg(delta_t_s) OVER (PARTITION BY series_id) AS x FROM intervals),
 l AS (SELECT *, {', '.join(f'x * lag(x, {j}) OVER w AS l{j}' for j in range(1, _LAGS + 1))} FROM c WINDOW w AS (PARTITION BY series_id ORDER BY k)),
 s AS (SELECT series_id, count(*) AS n, sum(x * x) AS s, {', '.join(f'coalesce(sum(l{j}), 0) AS l{j}' for j in range(1, _LAGS + 1))} FROM l GROUP BY series_id)
 SELECT series_id, n, {r('n * (n + 2) * (' + ' + '.join(f'power(l{j} / s, 2) / (n - {j})' for j in range(1, _LAGS + 1)) + ')', 'q')} FROM s""",
)
def ljung_box(spark, d):
    return rounded(hypothesis.ljung_box(_dt(spark, d), "delta_t_s", _LAGS).select("series_id", "n", "q"))


_ALL_LAGS = 20


@register(
    "ljung_box_test",
    f"""{_WITH}, c AS (SELECT series_id, k, delta_t_s - avg(delta_t_s) OVER (PARTITION BY series_id) AS x FROM intervals),
 l AS (SELECT *, {', '.join(f'x * lag(x, {j}) OVER w AS l{j}' for j in range(1, _ALL_LAGS + 1))} FROM c WINDOW w AS (PARTITION BY series_id ORDER BY k)),
 s AS (SELECT series_id, count(*) AS n, sum(x * x) AS s, {', '.join(f'coalesce(sum(l{j}), 0) AS l{j}' for j in range(1, _ALL_LAGS + 1))} FROM l GROUP BY series_id),
 m AS (SELECT *, CAST(CASE WHEN n < {_ALL_LAGS + 1} THEN greatest(1, n // 4) ELSE {_ALL_LAGS} END AS INTEGER) AS lags FROM s),
 t AS (SELECT *, n * (n + 2) * ({' + '.join(f'CASE WHEN lags >= {j} THEN power(l{j} / s, 2) / (n - {j}) ELSE 0 END' for j in range(1, _ALL_LAGS + 1))}) AS stat FROM m)
 SELECT series_id, n, lags, {r('stat', 'q')}, {r(chi2_tail('stat', 'lags'), 'p_value')}, {chi2_tail('stat', 'lags')} > 0.05 AS white FROM t""",
)
def ljung_box_test(spark, d):
    return rounded(hypothesis.ljung_box(_dt(spark, d), "delta_t_s", _ALL_LAGS))


_KRUSKAL = f"""{_WITH}, kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, channel) AS g FROM intervals) WHERE g >= 2),
 rk AS (SELECT *, count(*) OVER (PARTITION BY series_id, delta_t_s) AS ties, rank() OVER (PARTITION BY series_id ORDER BY delta_t_s) + (count(*) OVER (PARTITION BY series_id, delta_t_s) - 1) / 2 AS rk FROM kept),
 t AS (SELECT series_id, CAST(sum(ties * ties) - count(*) AS DOUBLE) AS t FROM rk GROUP BY series_id), s AS (SELECT series_id, channel, sum(rk) AS rs, count(*) AS n FROM rk GROUP BY ALL),
 m AS (SELECT series_id, sum(rs * rs / n) AS rr, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups FROM s GROUP BY series_id),
 h AS (SELECT series_id, groups, n, (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - t / (n::DOUBLE * n * n - n)) AS h FROM m JOIN t USING (series_id))
"""


@register("kruskal_h", f"{_KRUSKAL} SELECT series_id, groups, n, {r('h')}, {r('greatest(0, (h - groups + 1) / (n - groups))', 'eta_squared')} FROM h")
def kruskal_h(spark, d):
    out = hypothesis.kruskal(_dt(spark, d), "delta_t_s", "channel", "series_id")
    return rounded(out.select("series_id", "groups", "n", "h", "eta_squared"))


@register("kruskal_test", f"{_KRUSKAL} SELECT series_id, groups, {r('h')}, {r(chi2_tail('h', '(groups - 1)'), 'p_value')} FROM h")
def kruskal_test(spark, d):
    return rounded(hypothesis.kruskal(_dt(spark, d), "delta_t_s", "channel", "series_id").select("series_id", "groups", "h", "p_value"))


@register(
    "mann_whitney_u",
    f"""{_WITH}, g AS (SELECT DISTINCT channel AS c FROM intervals), p AS (SELECT x.c AS a, y.c AS b FROM g x JOIN g y ON x.c < y.c),
 rows_ AS (SELECT a, b, channel, delta_t_s AS v FROM intervals JOIN p ON channel = a OR channel = b),
 rk AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2 AS rk FROM rows_),
 m AS (SELECT a, b, sum(CASE WHEN channel = a THEN rk END) AS rs, count(*) FILTER (WHERE channel = a) AS n1, count(*) FILTER (WHERE channel = b) AS n2 FROM rk GROUP BY a, b)
 SELECT a, b, n1, n2, {r('rs - n1 * (n1 + 1) / 2', 'u', 2)}, {r('1 - 2 * (rs - n1 * (n1 + 1) / 2) / (n1 * n2)', 'rank_biserial')} FROM m""",
)
def mann_whitney_u(spark, d):
    out = hypothesis.mann_whitney(_dt(spark, d), "delta_t_s", "channel").select("a", "b", "n1", "n2", "u", "rank_biserial")
    return rounded(rounded(out, 2, "u"), 6, "rank_biserial")


def _pairs_sql(source: str, group: str, value: str) -> str:
    """u, ties and z of all pairs of groups."""
    return f"""x AS (SELECT {group} AS g, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {group} IS NOT NULL AND {value} IS NOT NULL), g AS (SELECT DISTINCT g FROM x),
 p AS (SELECT x.g AS a, y.g AS b FROM g x JOIN g y ON x.g < y.g), rows_ AS (SELECT a, b, g, v FROM x JOIN p ON g = a OR g = b),
 rk AS (SELECT *, count(*) OVER (PARTITION BY a, b, v) AS same, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2 AS rk FROM rows_),
 m AS (SELECT a, b, sum(CASE WHEN g = a THEN rk END) AS rs, count(*) FILTER (WHERE g = a) AS n1, count(*) FILTER (WHERE g = b) AS n2, CAST(sum(same * same - 1) AS DOUBLE) AS ties FROM rk GROUP BY a, b),
 us AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM m),
 zs AS (SELECT *, coalesce(greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 0), 0) AS z FROM us)"""


def _tested(out):
    return rounded(rounded(out, 2, "u"), 6, "z", "rank_biserial", "p_value")


_PAIR = f"a, b, n1, n2, {r('u', 'u', 2)}, {r('z')}, {r('1 - 2 * u / (n1 * n2)', 'rank_biserial')}"


@register(
    "mann_whitney_test",
    f"{_WITH}, {_pairs_sql('intervals', 'channel', 'delta_t_s')}, ps AS (SELECT *, least(1, 2 * ({normal_tail('z')})) AS p FROM zs) SELECT {_PAIR}, {r('p', 'p_value')}, p < 0.05 / (SELECT count(*) FROM m) AS significant FROM ps",
)
def mann_whitney_test(spark, d):
    return _tested(hypothesis.mann_whitney(_dt(spark, d), "delta_t_s", "channel"))


@register(
    "mann_whitney_small",
    f"""WITH RECURSIVE {_pairs_sql('supplier', 's_nationkey', 's_acctbal')},
 orders_ AS (SELECT 0 AS i, 0 AS j, 0 AS up, CAST(1 AS DOUBLE) AS ways UNION ALL
 SELECT i, j, up, sum(ways) FROM (SELECT i + 1 AS i, j, up + j AS up, ways FROM orders_ WHERE i < 8 UNION ALL SELECT i, j + 1, up, ways FROM orders_ WHERE j < (SELECT least(60, max(greatest(n1, n2))) FROM m)) GROUP BY i, j, up),
 exact AS (SELECT i, j, up, sum(ways) OVER (PARTITION BY i, j ORDER BY up DESC) / sum(ways) OVER (PARTITION BY i, j) AS tail FROM orders_),
 ps AS (SELECT zs.*, least(1, 2 * CASE WHEN ties = 0 AND least(n1, n2) <= 8 THEN tail ELSE {normal_tail('z')} END) AS p FROM zs
 LEFT JOIN exact ON i = least(n1, n2) AND j = greatest(n1, n2) AND up = greatest(u, n1 * n2 - u))
 SELECT {_PAIR}, {r('p', 'p_value')}, p < 0.05 / (SELECT count(*) FROM m) AS significant FROM ps""",
)
def mann_whitney_small(spark, d):
    """Suppliers' balances by nation: groups of a few rows, whose p-values are exact where there are no ties."""
    return _tested(hypothesis.mann_whitney(read(spark, d, "supplier"), "s_acctbal", "s_nationkey"))


@register(
    "ks_two_sample",
    f"""{_WITH}, c AS (SELECT series_id, delta_t_s AS v, count(*) FILTER (WHERE k < 30) AS x, count(*) FILTER (WHERE k >= 30) AS y FROM intervals GROUP BY ALL),
 f AS (SELECT series_id, sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER s AS n1, sum(y) OVER s AS n2 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY v), s AS (PARTITION BY series_id)),
 m AS (SELECT series_id, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2, max(abs(cx / n1 - cy / n2)) AS d FROM f WHERE n1 > 0 AND n2 > 0 GROUP BY series_id),
 l AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS x FROM m),
 p AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 51), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x))))) END AS p FROM l)
 SELECT series_id, n1, n2, {r('d', 'distance')}, {r('p', 'p_value')}, p < 0.05 AS differ FROM p""",
)
def ks_two_sample(spark, d):
    return rounded(hypothesis.two_sample_ks(_dt(spark, d), "delta_t_s", F.col("k") < 30))


@register(
    "cohens_d",
    f"""{_WITH}, m AS (SELECT series_id, count(*) FILTER (WHERE k < 30) AS n1, count(*) FILTER (WHERE k >= 30) AS n2, avg(delta_t_s) FILTER (WHERE k < 30) AS m1, avg(delta_t_s) FILTER (WHERE k >= 30) AS m2,
 var_samp(delta_t_s) FILTER (WHERE k < 30) AS v1, var_samp(delta_t_s) FILTER (WHERE k >= 30) AS v2 FROM intervals GROUP BY series_id)
 SELECT series_id, n1, n2, {r('CASE WHEN n1 >= 2 AND n2 >= 2 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) ELSE 0 END', 'cohens_d')} FROM m""",
)
def cohens_d(spark, d):
    return rounded(hypothesis.cohens_d(_dt(spark, d), "delta_t_s", F.col("k") < 30))


_ADF_LAGS = 5


@register(
    "adf_sums",
    f"""{_WITH}, c AS (SELECT series_id, k, log10(delta_t_s) - avg(log10(delta_t_s)) OVER (PARTITION BY series_id) AS x FROM intervals),
 ds AS (SELECT *, lead(x) OVER (PARTITION BY series_id ORDER BY k) - x AS d FROM c),
 l AS (SELECT series_id, x, d, unnest(range({_ADF_LAGS + 1})) AS lag, unnest([{', '.join(f'lag(d, {j}) OVER w' if j else 'd' for j in range(_ADF_LAGS + 1))}]) AS p FROM ds WINDOW w AS (PARTITION BY series_id ORDER BY k))
 SELECT series_id, CAST(lag AS INTEGER) AS lag, count(*) AS n, {r('sum(d * p)', 'dd')}, {r('sum(CASE WHEN d IS NOT NULL THEN x * p END)', 'xd')} FROM l GROUP BY series_id, lag""",
)
def adf_sums(spark, d):
    sums = hypothesis.adf_sums(_dt(spark, d).withColumn("log10_dt", F.log10("delta_t_s")), "log10_dt", lags=_ADF_LAGS)
    rows = sums.select("series_id", "n", F.posexplode(F.arrays_zip("dd", "xd")).alias("lag", "e"))
    return rounded(rows.select("series_id", "lag", "n", "e.dd", "e.xd"))


@register("adf_test")
def adf_test(spark, d):
    return hypothesis.adf(_dt(spark, d).withColumn("log10_dt", F.log10("delta_t_s")), "log10_dt")


@register("bootstrap_median")
def bootstrap_median(spark, d):
    return hypothesis.bootstrap(_dt(spark, d), "delta_t_s")


@register("validation_report")
def validation_report(spark, d):
    tracked = track.kalman(_dt(spark, d).withColumn("segment", F.floor(F.col("k") / 20)), 1e8, 1e8, 1e8, 1e12)
    return hypothesis.report(tracked, 1e9)
