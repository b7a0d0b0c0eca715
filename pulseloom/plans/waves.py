"""Queries over sampled waveforms (lineitem, one for each supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from pulseloom.operators import campaign, conditioning, decide, detect, features, intervals
from pulseloom.operators.campaign import curve_name
from pulseloom.plans.catalog import register
from pulseloom.plans.common import r, rounded
from pulseloom.sources.tables import WAVEFORMS_SQL, parts, read, waveforms

_W = f"WITH {WAVEFORMS_SQL}"
_ALL = "OVER (PARTITION BY series_id)"
SIZE, OVERLAP = 64, 32
FS = 1e6


@register(
    "nan_drop",
    f"""{_W}, holes AS (SELECT series_id, idx, x FROM waves WHERE idx % 7 NOT IN (3, 5))
 SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS idx, {r('x')} FROM holes""",
)
def nan_drop(spark, d):
    holes = F.when(F.col("idx") % 7 == 3, F.lit(None)).when(F.col("idx") % 7 == 5, F.lit(float("nan"))).otherwise(F.col("x"))
    return rounded(conditioning.drop_nan(waveforms(spark, d).withColumn("x", holes)))


@register("center", f"{_W} SELECT series_id, idx, {r(f'x - avg(x) {_ALL}', 'x', 3)} FROM waves")
def center(spark, d):
    return rounded(conditioning.center(waveforms(spark, d)), 3)


@register("center_maxabs", f"{_W}, c AS (SELECT series_id, idx, x - avg(x) {_ALL} AS x FROM waves) SELECT series_id, idx, {r(f'CASE WHEN max(abs(x)) {_ALL} = 0 THEN x ELSE x / max(abs(x)) {_ALL} END', 'x')} FROM c")
def center_maxabs(spark, d):
    return rounded(conditioning.center_maxabs(waveforms(spark, d)))


@register("normalize_zscore", f"{_W} SELECT series_id, idx, {r(f'CASE WHEN stddev_pop(x) {_ALL} = 0 THEN x - avg(x) {_ALL} ELSE (x - avg(x) {_ALL}) / stddev_pop(x) {_ALL} END', 'x')} FROM waves")
def normalize_zscore(spark, d):
    return rounded(conditioning.normalize(waveforms(spark, d), "zscore"))


@register("normalize_minmax", f"{_W} SELECT series_id, idx, {r(f'CASE WHEN max(x) {_ALL} = min(x) {_ALL} THEN x - min(x) {_ALL} ELSE (x - min(x) {_ALL}) / (max(x) {_ALL} - min(x) {_ALL}) END', 'x')} FROM waves")
def normalize_minmax(spark, d):
    return rounded(conditioning.normalize(waveforms(spark, d), "minmax"))


@register(
    "normalize_robust",
    f"""{_W}, m AS (SELECT series_id, quantile_cont(x, 0.5) AS c FROM waves GROUP BY series_id),
 s AS (SELECT series_id, any_value(c) AS c, 1.4826 * quantile_cont(abs(x - c), 0.5) AS s FROM waves JOIN m USING (series_id) GROUP BY series_id)
 SELECT series_id, idx, {r('CASE WHEN s = 0 THEN x - c ELSE (x - c) / s END', 'x')} FROM waves JOIN s USING (series_id)""",
)
def normalize_robust(spark, d):
    return rounded(conditioning.normalize(waveforms(spark, d), "robust"))


@register(
    "baseline_zscore",
    f"""{_W}, b AS (SELECT series_id, avg(x) FILTER (WHERE idx < 100) AS m, stddev_pop(x) FILTER (WHERE idx < 100) AS s, count(*) AS n FROM waves GROUP BY series_id)
 SELECT series_id, idx, {r('CASE WHEN n <= 100 THEN x ELSE (x - m) / (s + 1e-12) END', 'x')} FROM waves JOIN b USING (series_id)""",
)
def baseline_zscore(spark, d):
    return rounded(conditioning.baseline_zscore(waveforms(spark, d), 100))


@register(
    "rmse_pairs",
    f"""{_W}, s AS (SELECT series_id, idx, x, avg(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y FROM waves)
 SELECT series_id, {r('sqrt(avg((x - y) * (x - y)))', 'rmse', 3)} FROM s GROUP BY series_id""",
)
def rmse_pairs(spark, d):
    x = waveforms(spark, d)
    smooth = x.withColumn("x", F.avg("x").over(Window.partitionBy("series_id").orderBy("idx").rowsBetween(-4, 0)))
    return rounded(conditioning.rmse(x, smooth), 3)


def _cfar_sql(window: int, guard: int, pfa: float) -> str:
    alpha = window * (pfa ** (-1.0 / window) - 1)
    left = f"OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {window + guard} PRECEDING AND {guard + 1} PRECEDING)"
    right = f"OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {guard + 1} FOLLOWING AND {window + guard} FOLLOWING)"
    return f"""cells AS (SELECT series_id, idx, x, x * x AS power, (sum(x * x) {left} + sum(x * x) {right}) / {2 * window} AS noise, count(*) {left} AS nl, count(*) {right} AS nr FROM waves),
 cfar AS (SELECT series_id, idx, x, power, noise FROM cells WHERE nl = {window} AND nr = {window} AND power > {alpha!r} * noise)"""


_CFAR = f"{_W}, {_cfar_sql(64, 8, 0.2)}"


@register("cfar_detect", f"{_CFAR} SELECT series_id, idx, {r('power', digits=1)}, {r('noise', digits=1)} FROM cfar")
def cfar_detect(spark, d):
    return rounded(detect.cfar(waveforms(spark, d), 64, 8, 0.2).select("series_id", "idx", "power", "noise"), 1)


@register("first_arrival", f"{_CFAR}, g AS (SELECT *, idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx) AS gap FROM cfar) SELECT series_id, idx FROM g WHERE gap IS NULL OR gap > 2")
def first_arrival(spark, d):
    return intervals.first_arrivals(detect.cfar(waveforms(spark, d), 64, 8, 0.2), 2).select("series_id", "idx")


_PEAKS = f"""{_W}, m AS (SELECT series_id, idx, abs(round(x, -3)) AS m FROM waves), l AS (SELECT series_id, avg(m) + 1.0 * stddev_pop(m) AS lim FROM m GROUP BY series_id),
 f AS (SELECT *, CASE WHEN m = lag(m) OVER (PARTITION BY series_id ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM m),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY idx) AS run FROM f),
 runs AS (SELECT series_id, run, min(idx) AS a, max(idx) AS b, any_value(m) AS v FROM n GROUP BY ALL),
 near AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY run)),
 peaks AS (SELECT series_id, CAST((a + b) // 2 AS BIGINT) AS idx, v AS peak_v FROM near JOIN l USING (series_id) WHERE v > pv AND v > nv AND v >= lim)"""


def _peaks(spark, d):
    return detect.threshold_peaks(waveforms(spark, d).withColumn("x", F.round("x", -3)), 1.0)


@register("threshold_peaks", f"{_PEAKS} SELECT series_id, idx, peak_v FROM peaks")
def threshold_peaks(spark, d):
    return _peaks(spark, d).select("series_id", "idx", "peak_v")


@register(
    "pulse_windows",
    f"{_PEAKS} SELECT p.series_id, p.idx AS pulse_idx, count(*) AS n, {r('max(x)', 'top')} FROM peaks p JOIN waves w ON w.series_id = p.series_id AND w.idx >= p.idx - 3 AND w.idx < p.idx + 8 GROUP BY ALL",
)
def pulse_windows(spark, d):
    found = detect.pulse_windows(waveforms(spark, d), _peaks(spark, d), 3, 8, parts(spark, d, "lineitem"))
    return rounded(found.groupBy("series_id", "pulse_idx").agg(F.count("*").alias("n"), F.max("x").alias("top")))


_METRICS = f"""{_W}, tm0 AS (SELECT series_id, max(x) - min(x) AS vpp, max(abs(x)) AS peak_abs, sqrt(avg(CASE WHEN idx < 16 THEN x * x END)) AS noise_rms, sum(x * x) / {FS} AS energy FROM waves GROUP BY series_id),
 tm AS (SELECT *, CASE WHEN noise_rms > 0 THEN peak_abs / noise_rms ELSE 'infinity'::DOUBLE END AS z_peak FROM tm0)"""


@register("time_metrics", f"{_METRICS} SELECT series_id, {r('vpp', digits=3)}, {r('peak_abs', digits=3)}, {r('noise_rms', digits=3)}, {r('energy', digits=3)}, {r('z_peak', digits=5)}, {r('20 * log10(z_peak)', 'snr_db', 5)} FROM tm")
def time_metrics(spark, d):
    m = campaign.time_metrics(waveforms(spark, d), FS, 40.0)
    return rounded(rounded(m, 3, "vpp", "peak_abs", "noise_rms", "energy"), 5, "z_peak", "snr_db")


_FILES = f"{_METRICS}, files AS (SELECT tm.*, r_name AS dataset, n_name AS antenna FROM tm JOIN supplier ON s_suppkey = series_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"
KS = [1.0, 1.5, 2.0]


def _files(spark, d):
    where = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    where = read(spark, d, "supplier").join(F.broadcast(where), F.col("s_nationkey") == F.col("n_nationkey"))
    where = where.select(F.col("s_suppkey").alias("series_id"), F.col("r_name").alias("dataset"), F.col("n_name").alias("antenna"))
    return campaign.time_metrics(waveforms(spark, d), FS, 40.0).join(where, "series_id")


@register("group_mean_median", f"{_FILES} SELECT dataset, antenna, {r('avg(vpp)', 'vpp_mean', 3)}, {r('quantile_cont(vpp, 0.5)', 'vpp_median', 3)}, {r('avg(energy)', 'energy_mean', 3)}, {r('quantile_cont(energy, 0.5)', 'energy_median', 3)} FROM files GROUP BY ALL")
def group_mean_median(spark, d):
    return rounded(campaign.mean_median(_files(spark, d), ["dataset", "antenna"], ["vpp", "energy"]), 3)


_CURVES = _FILES + ", curves AS (SELECT dataset, k_sigma, avg(CAST(z_peak >= k_sigma AS INT)) AS pd FROM files, (SELECT unnest([1.0, 1.5, 2.0]::DOUBLE[]) AS k_sigma) GROUP BY ALL)"


@register("detection_curves", f"{_CURVES} SELECT dataset, k_sigma, {r('pd')}, {r('100 * pd', 'pd_percent')} FROM curves")
def detection_curves(spark, d):
    return rounded(campaign.detection_curves(_files(spark, d), ["dataset"], KS))


@register("detection_pivot", _CURVES + " SELECT dataset, " + ", ".join(r(f"max(CASE WHEN k_sigma = {k} THEN 100 * pd END)", curve_name(k)) for k in KS) + " FROM curves GROUP BY dataset")
def detection_pivot(spark, d):
    wide = campaign.pivot_curves(campaign.detection_curves(_files(spark, d), ["dataset"], KS), ["dataset"], KS)
    return wide.select("dataset", *[(F.round(curve_name(k), 6) + F.lit(0.0)).alias(curve_name(k)) for k in KS])


@register(
    "slice_metrics",
    f"""{_W}, g AS (SELECT series_id, idx // 200 AS grp, idx, x FROM waves), s AS (SELECT series_id, grp, count(*) AS n, sum(x * x) / {FS} AS e, max(abs(x)) AS p, sqrt(avg(CASE WHEN idx < grp * 200 + 64 THEN x * x END)) AS s FROM g GROUP BY ALL)
 SELECT series_id, CAST(grp AS BIGINT) AS grp, {r('CASE WHEN n > 100 THEN e ELSE 0 END', 'mean_energy', 3)}, {r('CASE WHEN n > 100 AND s > 0 THEN 20 * log10(p / s) ELSE 0 END', 'mean_snr_db', 5)} FROM s""",
)
def slice_metrics(spark, d):
    x = waveforms(spark, d)
    groups = x.select("series_id", F.floor(F.col("idx") / 200).alias("grp")).distinct().withColumns({"first_idx": F.col("grp") * 200, "last_idx": F.col("grp") * 200 + 200})
    m = campaign.slice_metrics(x, groups, FS)
    return rounded(rounded(m, 3, "mean_energy"), 5, "mean_snr_db")


def _sliding_sql(size: int, step: int) -> str:
    return f"""n AS (SELECT series_id, max(idx) + 1 AS n FROM waves GROUP BY series_id),
 win AS (SELECT series_id, unnest(range(0, (n - {size}) // {step} + 1)) AS win_id FROM n WHERE n >= {size}),
 slide AS (SELECT w.series_id, win_id, w.idx - win_id * {step} AS pos, w.idx, x FROM win JOIN waves w ON w.series_id = win.series_id AND w.idx >= win_id * {step} AND w.idx < win_id * {step} + {size})"""


_EPS = 1e-15
_DESC = f"""{_W}, {_sliding_sql(SIZE, SIZE - OVERLAP)},
 tot AS (SELECT *, x * x / (sum(x * x) OVER (PARTITION BY series_id, win_id) + {_EPS}) AS p, avg(x) OVER (PARTITION BY series_id, win_id) AS mu,
 CASE WHEN sign(x) <> lag(sign(x)) OVER (PARTITION BY series_id, win_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM slide),
 agg AS (SELECT series_id, win_id, var_pop(x) AS "Variance", avg(power(x - mu, 4)) / power(var_pop(x), 2) AS "Kurtosis", avg(power(x - mu, 3)) / power(var_pop(x), 1.5) AS "Skewness",
 sqrt(avg(x * x)) AS "RMS", avg(abs(x)) AS a, max(abs(x)) AS m, avg(sqrt(abs(x))) AS q, -sum(p * log2(p + {_EPS})) AS "Shannon", sum(x * x) AS "Energy", sum(turn) / {SIZE - 1} AS "ZCR",
 quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS "IQR" FROM tot GROUP BY series_id, win_id),
 descr AS (SELECT *, "RMS" / a AS "Waveform", m / "RMS" AS "Crest", m / a AS "Impulse", m / (q * q) AS "Clearance" FROM agg)"""
_DIGITS = {"Variance": 1, "Energy": 0, "RMS": 3}


def _centred(spark, d):
    return conditioning.center(waveforms(spark, d))


_CDESC = _DESC.replace(WAVEFORMS_SQL, WAVEFORMS_SQL.replace("waves AS", "raw AS") + f", waves AS (SELECT series_id, idx, x - avg(x) {_ALL} AS x FROM raw)")


def _descriptors(spark, d):
    return features.descriptors(_centred(spark, d), SIZE, OVERLAP)


@register("descriptors12", _CDESC + " SELECT series_id, win_id, " + ", ".join(r(f'"{n}"', f'"{n}"', _DIGITS.get(n, 5)) for n in features.NAMES) + " FROM descr")
def descriptors12(spark, d):
    out = _descriptors(spark, d)
    for n in features.NAMES:
        out = rounded(out, _DIGITS.get(n, 5), n)
    return out


_PAIRS = [(a, b) for i, a in enumerate(features.NAMES) for b in features.NAMES[i + 1 :]]


@register("descriptor_corr", _CDESC + " " + " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, {r(f'corr("{a}", "{b}")', 'corr', 5)} FROM descr""" for a, b in _PAIRS))
def descriptor_corr(spark, d):
    return rounded(features.correlations(_descriptors(spark, d)), 5)


_LONG = _CDESC + ", vals AS (" + " UNION ALL ".join(f"""SELECT series_id, win_id, '{n}' AS descriptor, "{n}" AS value FROM descr""" for n in ("Variance", "Crest", "Shannon", "IQR")) + ")"
_GSQL = (
    _LONG
    + f""", cutted AS (SELECT *, count(*) OVER w AS n, CAST(floor(count(*) OVER w * 0.5) AS BIGINT) AS cut FROM vals WINDOW w AS (PARTITION BY series_id, descriptor)),
 zz AS (SELECT *, (value - avg(CASE WHEN win_id < cut THEN value END) OVER w) / (stddev_pop(CASE WHEN win_id < cut THEN value END) OVER w + {_EPS}) AS z FROM cutted WINDOW w AS (PARTITION BY series_id, descriptor)),
 aim AS (SELECT *, avg(CASE WHEN win_id < 200 THEN z END) OVER (PARTITION BY series_id, descriptor) AS t FROM zz),
 ud AS (SELECT *, sum(CASE WHEN win_id > 0 THEN z - t - 0.5 ELSE 0 END) OVER v AS up, sum(CASE WHEN win_id > 0 THEN t - z - 0.5 ELSE 0 END) OVER v AS down FROM aim WINDOW v AS (PARTITION BY series_id, descriptor ORDER BY win_id)),
 gs AS (SELECT series_id, descriptor, win_id, cut, n, win_id >= cut AS after, greatest(up - min(up) OVER v, down - min(down) OVER v) AS g FROM ud WINDOW v AS (PARTITION BY series_id, descriptor ORDER BY win_id))"""
)


def _values(spark, d):
    return features.long_form(_descriptors(spark, d).select("series_id", "win_id", "Variance", "Crest", "Shannon", "IQR"), ["Variance", "Crest", "Shannon", "IQR"])


_PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(fp / nullif(neg, 0), 0) AS fpr"


@register(
    "ablation",
    _GSQL
    + f""", c AS (SELECT series_id, descriptor, count(*) FILTER (WHERE g > 5 AND after) AS tp, count(*) FILTER (WHERE g > 5 AND NOT after) AS fp, count(*) FILTER (WHERE after) AS pos,
 count(*) FILTER (WHERE NOT after) AS neg, min(CASE WHEN g > 5 AND after THEN win_id - cut END) AS lat, count(*) FILTER (WHERE g > 5) AS total_alarms FROM gs GROUP BY ALL),
 p AS (SELECT *, {_PRF} FROM c)
 SELECT series_id, descriptor, {r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)', 'f1_score')}, coalesce(lat, pos) AS latency, {r('fpr')}, {r('precision')}, {r('recall')}, total_alarms FROM p""",
)
def ablation(spark, d):
    return rounded(features.ablation(_values(spark, d)))


@register(
    "roc_auc",
    _GSQL
    + f""", th AS (SELECT 0.5 + range * ((15.0 - 0.5) / 49) AS threshold FROM range(50)),
 c AS (SELECT series_id, descriptor, threshold, count(*) FILTER (WHERE g > threshold AND after) AS tp, count(*) FILTER (WHERE g > threshold AND NOT after) AS fp, count(*) FILTER (WHERE after) AS pos,
 count(*) FILTER (WHERE NOT after) AS neg FROM gs, (SELECT CAST(0.5 + range * ((15.0 - 0.5)::DOUBLE / 49) AS DOUBLE) AS threshold FROM range(50)) GROUP BY ALL),
 p AS (SELECT *, {_PRF} FROM c), f AS (SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 12) AS f1 FROM p),
 a AS (SELECT *, (fpr - lag(fpr) OVER w) * (recall + lag(recall) OVER w) / 2 AS area FROM f WINDOW w AS (PARTITION BY series_id, descriptor ORDER BY fpr, recall, threshold DESC)),
 best AS (SELECT series_id, descriptor, f1, threshold FROM f QUALIFY row_number() OVER (PARTITION BY series_id, descriptor ORDER BY f1 DESC, threshold) = 1)
 SELECT series_id, descriptor, {r('abs(coalesce(sum(area), 0))', 'auc')}, {r('any_value(b.f1)', 'best_f1')}, {r('any_value(b.threshold)', 'best_threshold')} FROM a JOIN best b USING (series_id, descriptor) GROUP BY series_id, descriptor""",
)
def roc_auc(spark, d):
    return rounded(features.roc(_values(spark, d)))


def _window_alarm_sql(measure: str, size: int, two_sided: bool) -> str:
    away = "abs(value - m)" if two_sided else "value - m"
    return f"""{_W.replace(WAVEFORMS_SQL, WAVEFORMS_SQL.replace("waves AS", "raw AS") + f", waves AS (SELECT series_id, idx, x - avg(x) {_ALL} AS x FROM raw)")}, {_sliding_sql(size, size // 2)},
 t AS (SELECT *, CASE WHEN sign(x) <> lag(sign(x)) OVER (PARTITION BY series_id, win_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM slide),
 v AS (SELECT series_id, win_id, {measure} AS value FROM t GROUP BY ALL), c AS (SELECT v.*, CAST(floor(n * 0.5) AS BIGINT) AS cut FROM v JOIN n USING (series_id)),
 e AS (SELECT *, CASE WHEN win_id * {size // 2} + {size} <= cut THEN value END AS early FROM c), l AS (SELECT *, avg(early) {_ALL} AS m, stddev_pop(early) {_ALL} AS s FROM e)
 SELECT series_id, win_id, win_id * {size // 2} + {size // 2} AS at, coalesce({away} > 1.5 * s, false) AS alarm, win_id * {size // 2} + {size // 2} >= cut AS after FROM l"""


@register("energy_detector", _window_alarm_sql("sum(x * x)", 64, False))
def energy_detector(spark, d):
    return decide.energy_alarms(_centred(spark, d), 64, 0.5, 1.5).select("series_id", "win_id", "at", "alarm", "after")


@register("zcr_detector", _window_alarm_sql("sum(turn) / 64", 64, True))
def zcr_detector(spark, d):
    return decide.zcr_alarms(_centred(spark, d), 64, 0.5, 1.5).select("series_id", "win_id", "at", "alarm", "after")


def _envelope_sql(rows: str, out: str) -> str:
    """The analytic signal's modulus by circular convolution with the transform's kernel at the series' length."""
    angle = "2 * pi() * j / n"
    kernel = f"CASE WHEN j = 0 THEN 0 ELSE (2.0 / n) * (cos({angle} / 2) - cos(((n - 1) // 2 + 0.5) * {angle})) / (2 * sin({angle} / 2)) END"
    return f"""{out}_x AS (SELECT series_id, count(*) AS n, list(x ORDER BY idx) AS xs FROM {rows} GROUP BY series_id), {out}_k AS (SELECT *, list_transform(range(n), lambda j: {kernel}) AS h FROM {out}_x),
 {out}_r AS (SELECT series_id, n, xs, list_reverse(list_concat(h, h)) AS r FROM {out}_k),
 {out} AS (SELECT series_id, idx, sqrt(power(xs[idx + 1], 2) + power(list_dot_product(xs, r[n - idx : 2 * n - 1 - idx]), 2)) AS env FROM {out}_r, unnest(range(n)) t(idx))"""


@register(
    "envelope_detector",
    f"""{_W}, c AS (SELECT series_id, idx, x - avg(x) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) // 2 AS cut FROM waves), early AS (SELECT series_id, idx, x FROM c WHERE idx < cut), whole AS (SELECT series_id, idx, x FROM c),
 {_envelope_sql('whole', 'e')}, {_envelope_sql('early', 'q')}, l AS (SELECT series_id, quantile_cont(env, 0.995) AS lim FROM q GROUP BY series_id)
 SELECT e.series_id, e.idx AS "at", {r('env', 'value', 3)}, e.idx >= cut AS after FROM e JOIN l USING (series_id) JOIN c ON c.series_id = e.series_id AND c.idx = e.idx WHERE env > lim""",
)
def envelope_detector(spark, d):
    return rounded(decide.envelope_alarms(_centred(spark, d)).select("series_id", "at", "value", "after"), 3)


@register("compare_baselines")
def compare_baselines(spark, d):
    return decide.compare_baselines(_centred(spark, d), 128, fs=FS)


@register("campaign_verdicts")
def campaign_verdicts(spark, d):
    return decide.campaign_verdicts(_centred(spark, d), FS, 128e-6, partitions=parts(spark, d, "lineitem"), k=1.5)


@register("campaign_summary")
def campaign_summary(spark, d):
    return decide.campaign_summary(campaign_verdicts(spark, d))
