"""Quantiles of large groups, densities, detection anew at each threshold, joined and deduplicated streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.operators import campaign, density, intervals, quantiles, resample
from pulseloom.plans.catalog import register
from pulseloom.plans.common import r, rounded
from pulseloom.plans.intervals import _FREQ, _PHASE
from pulseloom.plans.waves import _W
from pulseloom.sources.tables import PULSES_SQL, parts, pulses, read, waveforms

_SHARES = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


@register("price_quantiles", f"SELECT l_returnflag, {', '.join(r(f'quantile_cont(l_extendedprice, {p})', c, 4) for c, p in _SHARES.items())} FROM lineitem GROUP BY l_returnflag")
def price_quantiles(spark, d):
    """Three groups that hold the whole table, the largest with half of it."""
    return rounded(quantiles.group_quantiles(read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", _SHARES), 4)


_H, _FAR, _VAR = density.STEPS, density.STEPS * density.REACH, 1 - 1 / (3 * density.STEPS**2)
_CORNERS = "(VALUES (0), (1)) a_(a), (VALUES (0), (1)) b_(b)"
_PART = "(CASE a WHEN 1 THEN fu ELSE 1 - fu END) * (CASE b WHEN 1 THEN fv ELSE 1 - fv END)"


def _kernel_sql(step: str) -> str:
    return f"exp(-power(({step}) / {_H}.0, 2) / {2 * _VAR}) / sqrt(2 * pi() * {_VAR})"


@register(
    "phase_kernel_density",
    f"""{_PHASE}, p AS (SELECT series_id, k, phase_deg AS x, CASE WHEN phase_deg BETWEEN 0 AND 180 THEN peak_v ELSE -peak_v END AS y, abs(peak_v) AS w FROM phases),
 m AS (SELECT series_id, count(*) AS n, sum(w) AS t, sum(w * w) AS ww, sum(w * x) / sum(w) AS m1, sum(w * y) / sum(w) AS m2 FROM p WHERE w > 0 GROUP BY series_id),
 c AS (SELECT series_id, n, t, m1, m2, sum(w * (x - m1) * (x - m1)) / t * {0.15**2} / (1 - ww / (t * t)) AS cxx, sum(w * (x - m1) * (y - m2)) / t * {0.15**2} / (1 - ww / (t * t)) AS cxy,
  sum(w * (y - m2) * (y - m2)) / t * {0.15**2} / (1 - ww / (t * t)) AS cyy FROM p JOIN m USING (series_id) WHERE w > 0 GROUP BY series_id, n, t, ww, m1, m2),
 s AS (SELECT *, sqrt(cxx) AS l11, cxy / sqrt(cxx) AS l21, sqrt(cyy - cxy * cxy / cxx) AS l22 FROM c WHERE n > 2 AND cxx > 0 AND cyy - cxy * cxy / cxx > 1e-12 * cyy),
 u AS (SELECT series_id, k, w / t AS w, (x - m1) / l11 * {_H} AS u, (y - m2 - l21 * (x - m1) / l11) / l22 * {_H} AS v FROM p JOIN s USING (series_id)),
 f AS (SELECT *, CAST(floor(u) AS BIGINT) AS i, CAST(floor(v) AS BIGINT) AS j, u - floor(u) AS fu, v - floor(v) AS fv FROM u),
 nodes AS (SELECT series_id, i + a AS i, j + b AS j, sum(w * {_PART}) AS w FROM f, {_CORNERS} GROUP BY ALL),
 grid AS (SELECT q.series_id, q.i, q.j, sum(n.w * {_kernel_sql('q.i - n.i')} * {_kernel_sql('q.j - n.j')}) AS d FROM nodes q JOIN nodes n ON q.series_id = n.series_id AND abs(q.i - n.i) <= {_FAR} AND abs(q.j - n.j) <= {_FAR} GROUP BY ALL),
 found AS (SELECT f.series_id, f.k, sum({_PART} * d) AS d FROM f, {_CORNERS} JOIN grid ON grid.series_id = f.series_id AND grid.i = f.i + a AND grid.j = f.j + b GROUP BY ALL)
 SELECT p.series_id, p.k, {r('d / max(d) OVER (PARTITION BY p.series_id)', 'relative_density')} FROM p LEFT JOIN found ON found.series_id = p.series_id AND found.k = p.k""",
)
def phase_kernel_density(spark, d):
    """Density of all phases and signed amplitudes of each series, as a share of the series' largest."""
    phases = intervals.fold_phase(pulses(spark, d), _FREQ).select("series_id", "k", "phase_deg", "signed_v")
    out = density.kernel_density(phases, "phase_deg", "signed_v", keys=["series_id"], parts=parts(spark, d, "events"))
    share = F.col("density") / F.max("density").over(Window.partitionBy("series_id"))
    return rounded(out.select("series_id", "k", share.alias("relative_density")))


_KS, _CUTS, _RATE = [0.5, 1.0, 1.5], [4e-6, 1e-5, 3e-5], 1e6
_HALF = "0.5e-6"  # cut-offs between two gaps


@register(
    "detection_sensitivity",
    f"""{_W}, m AS (SELECT series_id, idx, round(abs(x), -3) AS m FROM waves), s AS (SELECT series_id, avg(m) AS mean, stddev_pop(m) AS sd FROM m GROUP BY series_id),
 n AS (SELECT *, CASE WHEN m = lag(m) OVER w THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY idx) AS run FROM n), runs AS (SELECT series_id, run, (min(idx) + max(idx)) // 2 AS pos, any_value(m) AS m FROM g GROUP BY ALL),
 tops AS (SELECT * FROM (SELECT *, m > lag(m) OVER w AND m > lead(m) OVER w AS top FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY run)) WHERE top),
 gaps AS (SELECT series_id, k_sigma, (pos - lag(pos) OVER (PARTITION BY series_id, k_sigma ORDER BY pos)) / {_RATE} AS dt FROM tops JOIN s USING (series_id), (SELECT unnest({_KS}::DOUBLE[]) AS k_sigma) WHERE m >= mean + k_sigma * sd)
 SELECT series_id, k_sigma, max_valid_dt_s, count(*) AS total_events, count(*) FILTER (WHERE dt <= max_valid_dt_s + {_HALF}) AS valid_events, count(*) FILTER (WHERE dt > max_valid_dt_s + {_HALF}) AS outliers
 FROM gaps, (SELECT unnest({_CUTS}::DOUBLE[]) AS max_valid_dt_s) WHERE dt IS NOT NULL GROUP BY ALL""",
)
def detection_sensitivity(spark, d):
    """Pulses of each waveform found anew at every threshold, and how many of their intervals each cut-off leaves."""
    samples = waveforms(spark, d).withColumn("x", F.round("x", -3))
    out = campaign.threshold_sensitivity(samples, _KS, [c + float(_HALF) for c in _CUTS], _RATE)
    return out.withColumn("max_valid_dt_s", F.round(F.col("max_valid_dt_s") - float(_HALF), 7))


_WITHIN, _MARK = "1 day", "purchase"
_NEAR = "m.series_id = p.series_id AND m.toa_s <= p.toa_s AND m.toa_s >= p.toa_s - 86400"


def _stages(spark, d, how):
    from pulseloom.streaming import tracking

    marks = tracking.source(spark, d, 1, "events.parquet*").filter(F.col("channel") == _MARK)
    out = tracking.replay(spark, d, lambda p: tracking.stage_events(p, marks, _WITHIN, how))
    return rounded(out.select("series_id", "event_id", "mark_id", "since_mark_s"), 3)


@register(
    "stream_stage_events",
    f"WITH {PULSES_SQL} SELECT p.series_id, p.event_id, m.event_id AS mark_id, {r('p.toa_s - m.toa_s', 'since_mark_s', 3)} FROM pulses p JOIN pulses m ON {_NEAR} WHERE m.channel = '{_MARK}'",
)
def stream_stage_events(spark, d):
    """Two streams of one watermark each, joined on series and a range of times."""
    return _stages(spark, d, "inner")


@register(
    "stream_unmarked",
    f"""WITH {PULSES_SQL} SELECT series_id, event_id FROM pulses p WHERE toa_s < (SELECT max(toa_s) - 3600 FROM pulses WHERE channel = '{_MARK}')
 AND NOT EXISTS (SELECT 1 FROM pulses m WHERE m.channel = '{_MARK}' AND {_NEAR})""",
)
def stream_unmarked(spark, d):
    """Pulses without a mark in the day before, given once the watermark of both streams has passed them."""
    return _stages(spark, d, "left").filter("mark_id IS NULL").select("series_id", "event_id")


@register("stream_without_repeats", f"WITH {PULSES_SQL} SELECT series_id, event_id, {r('toa_s', 'toa_s', 3)} FROM pulses")
def stream_without_repeats(spark, d):
    """A stream in which a third of the pulses are sent twice."""
    from pulseloom.streaming import tracking

    out = tracking.replay(spark, d, lambda p: tracking.without_repeats(p.unionByName(p.filter("event_id % 3 = 0"))))
    return rounded(out.select("series_id", "event_id", "toa_s"), 3)


@register("poisson_bootstrap")
def poisson_bootstrap(spark, d):
    """Interval of the median interval between the pulses of each series; held against draws for every row in the tests."""
    return resample.poisson_bootstrap(intervals.delta_t(pulses(spark, d)), "delta_t_s")
