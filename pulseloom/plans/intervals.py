"""Queries over pulse streams (events) and their intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.operators import campaign, intervals, rolling, track
from pulseloom.plans.catalog import register
from pulseloom.plans.common import r, rounded
from pulseloom.sources.tables import INTERVALS_SQL, PULSES_SQL, dealt, parts, pulses, read

#: The events are hours apart, so cut-off and gap are hours too.
CUT, GAP, Q, R, P0 = 20_000.0, 60_000.0, 0.5, 2.0, 1.0
ROWS, LEAST = 20, 5
ANTENNAS = {"click": "A1", "view": "A2", "purchase": "A3"}


def _dt(spark, d):
    return intervals.delta_t(pulses(spark, d))


def _flagged(spark, d):
    return intervals.flag_outliers(_dt(spark, d), CUT)


_WITH = f"WITH RECURSIVE {INTERVALS_SQL}"
_FLAGGED = _WITH + f", flagged AS (SELECT *, delta_t_s > {CUT} AS is_outlier, CASE WHEN delta_t_s <= {CUT} THEN delta_t_s END AS valid_dt FROM intervals)"


@register("delta_t", f"{_WITH} SELECT series_id, k, event_id, {r('delta_t_s')} FROM intervals")
def delta_t(spark, d):
    return rounded(_dt(spark, d).select("series_id", "k", "event_id", "delta_t_s"))


@register(
    "delta_t_log_rate",
    f"{_WITH} SELECT series_id, k, {r('log10(greatest(delta_t_s, 1e-12))', 'log10_dt')}, {r('1 / greatest(delta_t_s, 1e-12)', 'pulse_rate_hz', 12)} FROM intervals",
)
def delta_t_log_rate(spark, d):
    out = intervals.log_rate(_dt(spark, d)).select("series_id", "k", "log10_dt", "pulse_rate_hz")
    return rounded(rounded(out, 6, "log10_dt"), 12, "pulse_rate_hz")


@register("outlier_flag", f"{_FLAGGED} SELECT series_id, k, is_outlier, {r('valid_dt')} FROM flagged")
def outlier_flag(spark, d):
    return rounded(_flagged(spark, d).select("series_id", "k", "is_outlier", "valid_dt"))


@register("macro_gap_exclusion", f"{_WITH} SELECT series_id, count(*) AS n, {r('sum(delta_t_s)', 'total_s', 3)} FROM intervals WHERE delta_t_s <= {CUT} GROUP BY series_id")
def macro_gap_exclusion(spark, d):
    kept = _dt(spark, d).filter(F.col("delta_t_s") <= CUT)
    return rounded(kept.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("delta_t_s").alias("total_s")), 3)


@register("window_id", f"{_WITH} SELECT series_id, k, CAST(k // 10 AS BIGINT) AS window_id FROM intervals")
def window_id(spark, d):
    return rolling.window_ids(_dt(spark, d), 10).select("series_id", "k", "window_id")


_ELAPSED = _WITH + ", elapsed AS (SELECT *, sum(delta_t_s) OVER (PARTITION BY series_id ORDER BY k) AS elapsed_s FROM intervals)"


@register("cumulative_time", f"{_ELAPSED} SELECT series_id, k, {r('elapsed_s', digits=3)} FROM elapsed")
def cumulative_time(spark, d):
    return rounded(rolling.cumulative_time(_dt(spark, d)).select("series_id", "k", "elapsed_s"), 3)


@register("stage_by_time", f"{_ELAPSED} SELECT series_id, k, CAST(1 + CAST(elapsed_s > 5e5 AS INT) + CAST(elapsed_s > 1.5e6 AS INT) AS INT) AS stage FROM elapsed")
def stage_by_time(spark, d):
    return rolling.stages(rolling.cumulative_time(_dt(spark, d)), [5e5, 1.5e6], "elapsed_s").select("series_id", "k", "stage")


_AUTO = (
    _WITH
    + """, span AS (SELECT series_id, min(toa_s) AS t0, max(toa_s) AS t1 FROM intervals GROUP BY series_id),
 auto AS (SELECT i.*, CAST(1 + CAST(toa_s > t0 + 0.33 * (t1 - t0) AS INT) + CAST(toa_s > t0 + 0.66 * (t1 - t0) AS INT) AS INT) AS stage FROM intervals i JOIN span USING (series_id))"""
)


@register("stage_auto", f"{_AUTO} SELECT series_id, k, stage FROM auto")
def stage_auto(spark, d):
    return rolling.auto_stages(_dt(spark, d)).select("series_id", "k", "stage")


@register("stage_changes", f"{_AUTO} SELECT series_id, k, previous_stage, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY series_id ORDER BY k) AS previous_stage FROM auto) WHERE stage <> previous_stage")
def stage_changes(spark, d):
    return rolling.stage_changes(rolling.auto_stages(_dt(spark, d))).select("series_id", "k", "previous_stage", "stage")


_F = f"OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW)"


def _enough(expression: str) -> str:
    return f"CASE WHEN count(valid_dt) {_F} >= {LEAST} THEN {expression} END"


_ROLLING = f"""{_FLAGGED}, rolled AS (SELECT series_id, k, channel, is_outlier, valid_dt, {_enough(f'avg(1 / valid_dt) {_F}')} AS rolling_rate_hz,
 {_enough(f'quantile_cont(valid_dt, 0.5) {_F}')} AS rolling_median_dt,
 {_enough(f'quantile_cont(valid_dt, 0.75) {_F} - quantile_cont(valid_dt, 0.25) {_F}')} AS rolling_iqr_dt,
 {_enough(f'quantile_cont(valid_dt, 0.9) {_F}')} AS rolling_p90_dt,
 {_enough(f'stddev_samp(valid_dt) {_F} / avg(valid_dt) {_F}')} AS rolling_cv_dt FROM flagged)"""


@register("rolling_stats", f"{_ROLLING} SELECT series_id, k, {r('rolling_rate_hz', digits=9)}, {r('rolling_median_dt', digits=3)}, {r('rolling_iqr_dt', digits=3)}, {r('rolling_p90_dt', digits=3)}, {r('rolling_cv_dt')} FROM rolled")
def rolling_stats(spark, d):
    out = rolling.rolling_rates(_flagged(spark, d), ROWS).select("series_id", "k", "rolling_rate_hz", "rolling_median_dt", "rolling_iqr_dt", "rolling_p90_dt", "rolling_cv_dt")
    return rounded(rounded(rounded(out, 9, "rolling_rate_hz"), 3, "rolling_median_dt", "rolling_iqr_dt", "rolling_p90_dt"), 6, "rolling_cv_dt")


_B = "OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"


@register(
    "quantile_band",
    f"{_WITH} SELECT series_id, k, {r(f'CASE WHEN count(*) {_B} >= 5 THEN quantile_cont(delta_t_s, 0.25) {_B} END', 'band_low', 3)}, {r(f'CASE WHEN count(*) {_B} >= 5 THEN quantile_cont(delta_t_s, 0.75) {_B} END', 'band_high', 3)} FROM intervals",
)
def quantile_band(spark, d):
    return rounded(rolling.quantile_band(_dt(spark, d)).select("series_id", "k", "band_low", "band_high"), 3)


_S = "OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@register(
    "burstiness",
    f"""{_FLAGGED} SELECT series_id, k, {r(f'''CASE WHEN count(*) {_S} >= 3 AND count(valid_dt) {_S} = count(*) {_S}
 THEN (stddev_pop(valid_dt) {_S} - avg(valid_dt) {_S}) / (stddev_pop(valid_dt) {_S} + avg(valid_dt) {_S}) END''', 'rolling_burstiness')} FROM flagged""",
)
def burstiness(spark, d):
    return rounded(rolling.burstiness(_flagged(spark, d), 5, 3).select("series_id", "k", "rolling_burstiness"))


@register("sma", f"{_WITH} SELECT series_id, k, {r('avg(delta_t_s) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', 'sma', 3)} FROM intervals")
def sma(spark, d):
    return rounded(rolling.moving_average(_dt(spark, d)).select("series_id", "k", "sma"), 3)


@register("weibull_rolling")
def weibull_rolling(spark, d):
    return rolling.weibull(_flagged(spark, d), ROWS).select("series_id", "k", "weibull_beta", "weibull_eta")


def _cusum_sql(source: str, value: str, threshold: float, drift: float, burnin: int) -> str:
    return f"""aimed AS (SELECT *, avg({value}) FILTER (WHERE k < {burnin}) OVER (PARTITION BY series_id) AS mu FROM {source}),
 summed AS (SELECT *, sum(CASE WHEN k > 0 THEN {value} - mu - {drift} ELSE 0 END) OVER (PARTITION BY series_id ORDER BY k) AS up,
 sum(CASE WHEN k > 0 THEN mu - {value} - {drift} ELSE 0 END) OVER (PARTITION BY series_id ORDER BY k) AS down FROM aimed),
 cusum0 AS (SELECT *, up - min(up) OVER (PARTITION BY series_id ORDER BY k) AS g_plus, down - min(down) OVER (PARTITION BY series_id ORDER BY k) AS g_minus FROM summed),
 cusum AS (SELECT *, g_plus > {threshold} OR g_minus > {threshold} AS alarm FROM cusum0)"""


_CUSUM = _WITH + ", " + _cusum_sql("intervals", "delta_t_s", 100_000.0, 1_000.0, 20)


def _cusum(spark, d):
    return track.cusum(_dt(spark, d), "delta_t_s", 100_000.0, 1_000.0, 20)


@register("cusum_two_sided", f"{_CUSUM} SELECT series_id, k, {r('g_plus', digits=3)}, {r('g_minus', digits=3)}, alarm FROM cusum")
def cusum_two_sided(spark, d):
    return rounded(_cusum(spark, d).select("series_id", "k", "g_plus", "g_minus", "alarm"), 3)


_SUMMARY = f"""SELECT series_id, count(*) AS n, count(*) FILTER (WHERE alarm) AS n_alarms, min(k) FILTER (WHERE alarm) AS first_alarm,
 {r('max(g_plus)', 'max_g_plus', 3)}, {r('max(g_minus)', 'max_g_minus', 3)} FROM cusum GROUP BY series_id"""


@register("delta_t_tracking", f"{_CUSUM} {_SUMMARY}")
def delta_t_tracking(spark, d):
    return rounded(track.alarm_summary(_cusum(spark, d)), 3)


@register(
    "cusum_log_plot",
    f"""{_WITH}, logs AS (SELECT *, log10(greatest(delta_t_s, 1e-12)) AS log10_dt FROM intervals),
 zs AS (SELECT *, (log10_dt - avg(log10_dt) OVER w) / CASE WHEN stddev_pop(log10_dt) OVER w = 0 THEN 1 ELSE stddev_pop(log10_dt) OVER w END AS z FROM logs WINDOW w AS (PARTITION BY series_id)),
 ss AS (SELECT *, sum(z - 0.5) OVER v AS up, sum(-z - 0.5) OVER v AS down FROM zs WINDOW v AS (PARTITION BY series_id ORDER BY k))
 SELECT series_id, k, {r('up - least(0, min(up) OVER v)', 'c_plus')}, {r('-(down - least(0, min(down) OVER v))', 'c_minus')} FROM ss WINDOW v AS (PARTITION BY series_id ORDER BY k)""",
)
def cusum_log_plot(spark, d):
    return rounded(track.log_cusum(_dt(spark, d)).select("series_id", "k", "c_plus", "c_minus"))


def _kalman_sql(q: float, rr: float, p0: float, gap: float) -> str:
    before_x, before_p = f"CASE WHEN i.delta_t_s > {gap} THEN i.delta_t_s ELSE f.x END", f"CASE WHEN i.delta_t_s > {gap} THEN {p0} ELSE f.p END"
    ahead, s = f"({before_p} + {q})", f"({before_p} + {q} + {rr})"
    return f"""filtered AS (SELECT series_id, k, delta_t_s, delta_t_s AS x, (1 - ({p0} + {q}) / ({p0} + {q} + {rr})) * ({p0} + {q}) AS p, 0.0::DOUBLE AS innovation, ({p0} + {q} + {rr})::DOUBLE AS variance
 FROM intervals WHERE k = 0 UNION ALL SELECT i.series_id, i.k, i.delta_t_s, {before_x} + {ahead} / {s} * (i.delta_t_s - {before_x}), (1 - {ahead} / {s}) * {ahead},
 i.delta_t_s - {before_x}, {s} FROM filtered f JOIN intervals i ON i.series_id = f.series_id AND i.k = f.k + 1)"""


_KALMAN = _WITH + ", " + _kalman_sql(Q, R, P0, GAP)


def _kalman(spark, d):
    return track.kalman(_dt(spark, d), Q, R, P0, GAP)


@register("kalman_reset", f"{_KALMAN} SELECT series_id, k, {r('x', 'kalman_filtered', 3)}, {r('innovation / sqrt(variance)', 'kalman_z', 3)} FROM filtered")
def kalman_reset(spark, d):
    return rounded(_kalman(spark, d).select("series_id", "k", "kalman_filtered", "kalman_z"), 3)


@register("kalman_legacy", f"{_WITH}, {_kalman_sql(1e-5, 1e-2, 1.0, 1e300)} SELECT series_id, k, {r('x', 'kalman_filtered', 3)} FROM filtered")
def kalman_legacy(spark, d):
    return rounded(track.kalman_plain(_dt(spark, d)).select("series_id", "k", "kalman_filtered"), 3)


@register(
    "ewma_fixed",
    f"""{_WITH}, e AS (SELECT series_id, k, delta_t_s AS s FROM intervals WHERE k = 0 UNION ALL
 SELECT i.series_id, i.k, 0.2 * i.delta_t_s + (1 - 0.2) * e.s FROM e JOIN intervals i ON i.series_id = e.series_id AND i.k = e.k + 1) SELECT series_id, k, {r('s', 'ewma', 3)} FROM e""",
)
def ewma_fixed(spark, d):
    return rounded(track.ewma(_dt(spark, d)).select("series_id", "k", "ewma"), 3)


@register(
    "log_ewma",
    f"""{_WITH}, y AS (SELECT series_id, k, log10(greatest(delta_t_s, 1e-12)) AS y FROM intervals), m AS (SELECT series_id, quantile_cont(y, 0.5) AS m FROM y WHERE k < 50 GROUP BY series_id),
 e AS (SELECT series_id, k, y, m AS s FROM y JOIN m USING (series_id) WHERE k = 0 UNION ALL SELECT y.series_id, y.k, y.y, 0.2 * y.y + (1 - 0.2) * e.s FROM e JOIN y ON y.series_id = e.series_id AND y.k = e.k + 1)
 SELECT series_id, k, {r('y', 'log10_dt')}, {r('s', 'log_ewma')} FROM e""",
)
def log_ewma(spark, d):
    return rounded(track.log_ewma(_dt(spark, d)).select("series_id", "k", "log10_dt", "log_ewma"))


@register(
    "ewma_adaptive",
    f"""{_WITH}, a AS (SELECT *, least(0.8, greatest(0.05, 0.2 * (var_pop(delta_t_s) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 1e-30)
 / (var_pop(delta_t_s) OVER (PARTITION BY series_id) + 1e-30))) AS alpha FROM intervals),
 e AS (SELECT series_id, k, alpha, delta_t_s AS s FROM a WHERE k = 0 UNION ALL
 SELECT a.series_id, a.k, a.alpha, a.alpha * a.delta_t_s + (1 - a.alpha) * e.s FROM e JOIN a ON a.series_id = e.series_id AND a.k = e.k + 1)
 SELECT series_id, k, {r('alpha')}, {r('s', 'ewma', 3)} FROM e""",
)
def ewma_adaptive(spark, d):
    out = track.adaptive_ewma(_dt(spark, d)).select("series_id", "k", "alpha", "ewma")
    return rounded(rounded(out, 6, "alpha"), 3, "ewma")


@register(
    "unified_tracking",
    f"""{_KALMAN}, zs AS (SELECT series_id, k, x, innovation / sqrt(variance) AS z FROM filtered), {_cusum_sql('zs', 'z', 8.0, 0.5, 200)}
 SELECT series_id, k, {r('x', 'kalman_filtered', 3)}, {r('z', 'kalman_z', 3)}, {r('g_plus', digits=2)}, {r('g_minus', digits=2)}, alarm FROM cusum""",
)
def unified_tracking(spark, d):
    out = track.unified(_dt(spark, d), Q, R, P0, GAP).select("series_id", "k", "kalman_filtered", "kalman_z", "g_plus", "g_minus", "alarm")
    return rounded(rounded(out, 3, "kalman_filtered", "kalman_z"), 2, "g_plus", "g_minus")


@register(
    "zscore_diagnostics",
    f"""{_KALMAN}, zs AS (SELECT series_id, innovation / sqrt(variance) AS z FROM filtered)
 SELECT series_id, {r('avg(z)', 'z_mean', 3)}, {r('stddev_pop(z)', 'z_std', 3)}, {r('100 * avg(CAST(abs(z) > 3 AS INT))', 'pct_above_3')} FROM zs GROUP BY series_id""",
)
def zscore_diagnostics(spark, d):
    out = campaign.zscore_diagnostics(_kalman(spark, d))
    return rounded(rounded(out, 3, "z_mean", "z_std"), 6, "pct_above_3")


@register(
    "file_summary",
    f"""{_CUSUM} SELECT series_id, count(*) + 1 AS n_pulses, count(*) AS n_intervals, {r('avg(delta_t_s)', 'mean_dt', 3)}, {r('stddev_pop(delta_t_s)', 'std_dt', 3)},
 count(*) FILTER (WHERE alarm) AS n_alarms, bool_or(alarm) AS change_detected FROM cusum GROUP BY series_id""",
)
def file_summary(spark, d):
    return rounded(campaign.file_summary(_cusum(spark, d)), 3)


_TAPS = 8
_ZEROS = f"list_transform(range({_TAPS}), lambda j: 0::DOUBLE)"


@register(
    "lms_predict",
    f"""{_WITH}, f AS (SELECT series_id, k, delta_t_s / 1e5 AS x, delta_t_s / 1e5 AS guess, 0::DOUBLE AS e, {_ZEROS} AS w, {_ZEROS} AS seen FROM intervals WHERE k = {_TAPS - 1}
  UNION ALL SELECT series_id, k, x, guess, x - guess, list_transform(range({_TAPS}), lambda j: greatest(-10.0, least(10.0, w[j + 1] + 0.02 * (x - guess) * seen[j + 1]))), seen FROM (
   SELECT i.series_id, i.k, i.delta_t_s / 1e5 AS x, list_concat([f.x], f.seen[1:{_TAPS - 1}]) AS seen, f.w AS w, list_dot_product(f.w, list_concat([f.x], f.seen[1:{_TAPS - 1}])) AS guess FROM f JOIN intervals i ON i.series_id = f.series_id AND i.k = f.k + 1))
 SELECT series_id, k, {r('delta_t_s / 1e5', 'lms_prediction')}, 0.0::DOUBLE AS lms_error FROM intervals WHERE k < {_TAPS} UNION ALL SELECT series_id, k, {r('guess', 'lms_prediction')}, {r('e', 'lms_error')} FROM f WHERE k >= {_TAPS}""",
)
def lms_predict(spark, d):
    scaled = _dt(spark, d).withColumn("delta_t_s", F.col("delta_t_s") / 1e5)
    return rounded(track.lms(scaled).select("series_id", "k", "lms_prediction", "lms_error"))


@register("rls_predict")
def rls_predict(spark, d):
    return track.rls(_dt(spark, d)).select("series_id", "k", "rls_prediction", "rls_error")


@register("compare_trackers")
def compare_trackers(spark, d):
    return track.compare(_dt(spark, d).withColumn("delta_t_s", F.col("delta_t_s") / 1e5))


@register(
    "dead_time",
    f"""WITH pulse AS (SELECT o_custkey AS campaign, o_orderkey AS segment_id, epoch(o_orderdate)::DOUBLE AS trigger_epoch, l_linenumber + l_quantity / 100 AS t_s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
 kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY campaign, segment_id) AS n FROM pulse) WHERE n >= 2),
 numbered AS (SELECT *, row_number() OVER w - 1 AS part, t_s - lag(t_s) OVER w AS delta_t_s FROM kept WINDOW w AS (PARTITION BY campaign, segment_id ORDER BY t_s)),
 ends AS (SELECT campaign, segment_id, trigger_epoch, min(t_s) AS a, max(t_s) AS b FROM kept GROUP BY ALL),
 dead AS (SELECT campaign, segment_id, trigger_epoch, 0 AS part, (trigger_epoch + a) - (lag(trigger_epoch) OVER w + lag(b) OVER w) AS delta_t_s FROM ends WINDOW w AS (PARTITION BY campaign ORDER BY trigger_epoch, segment_id))
 SELECT campaign, segment_id, part, {r('delta_t_s')} FROM numbered WHERE part > 0 UNION ALL SELECT campaign, segment_id, part, {r('delta_t_s')} FROM dead WHERE trigger_epoch > 0 AND delta_t_s > 0""",
)
def dead_time(spark, d):
    epoch = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ)) / 1e6D")
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("segment_id"), epoch.alias("trigger_epoch"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment_id"), (F.col("l_linenumber") + F.col("l_quantity") / 100).alias("t_s"))
    n = parts(spark, d, "lineitem")
    pulse = dealt(orders, n, "segment_id").join(dealt(lines, n, "segment_id"), "segment_id")
    return rounded(intervals.stitch(pulse, partitions=n).select("campaign", "segment_id", "part", "delta_t_s"))


_FREQ = 0.001
_PHASE = (
    f"WITH {PULSES_SQL}"
    + f""", raw AS (SELECT *, (toa_s % {1.0 / _FREQ}) * {_FREQ} * 360.0 AS raw FROM pulses),
 centre AS (SELECT series_id, degrees(atan2(avg(sin(2 * radians(raw))), avg(cos(2 * radians(raw))))) / 2 AS c FROM raw GROUP BY series_id),
 phases AS (SELECT series_id, k, peak_v, ((raw - c + 70.0) % 360.0 + 360.0) % 360.0 AS phase_deg FROM raw JOIN centre USING (series_id))"""
)


@register("phase_fold", f"{_PHASE} SELECT series_id, k, {r('phase_deg', digits=4)}, {r('CASE WHEN phase_deg BETWEEN 0 AND 180 THEN peak_v ELSE -peak_v END', 'signed_v')} FROM phases")
def phase_fold(spark, d):
    out = intervals.fold_phase(pulses(spark, d), _FREQ).select("series_id", "k", "phase_deg", "signed_v")
    return rounded(rounded(out, 4, "phase_deg"), 6, "signed_v")


@register(
    "phase_outliers",
    f"""{_PHASE}, c2 AS (SELECT series_id, degrees(atan2(avg(sin(2 * radians(phase_deg))), avg(cos(2 * radians(phase_deg))))) / 2 AS c, count(*) AS n FROM phases GROUP BY series_id),
 near AS (SELECT p.*, n, ((phase_deg - c) % 180.0 + 180.0) % 180.0 AS part FROM phases p JOIN c2 USING (series_id)),
 dist AS (SELECT *, least(part, 180.0 - part) AS cd FROM near), mid AS (SELECT series_id, quantile_cont(cd, 0.5) AS m FROM dist GROUP BY series_id),
 mads AS (SELECT series_id, any_value(m) AS m, quantile_cont(abs(cd - m), 0.5) AS mad FROM dist JOIN mid USING (series_id) GROUP BY series_id)
 SELECT series_id, k, {r('cd', 'cluster_distance', 4)} FROM dist JOIN mads USING (series_id) WHERE cd <= m + 1.0 * greatest(1.4826 * mad, 5.0) OR n < 20""",
)
def phase_outliers(spark, d):
    out = intervals.phase_inliers(intervals.fold_phase(pulses(spark, d), _FREQ), 1.0)
    return rounded(out.select("series_id", "k", "cluster_distance"), 4)


@register("grid_frequency")
def grid_frequency(spark, d):
    return intervals.grid_frequency(pulses(spark, d))


@register(
    "phase_resultant",
    f"""WITH {PULSES_SQL}, grid AS (SELECT 0.0009 + range * 0.00001 AS freq_hz FROM range(21)),
 s AS (SELECT range, freq_hz, avg(cos(4 * pi() * freq_hz * (toa_s - 1.7e9))) AS c, avg(sin(4 * pi() * freq_hz * (toa_s - 1.7e9))) AS s FROM pulses, (SELECT range, 0.0009 + range * 0.00001 AS freq_hz FROM range(21)) GROUP BY ALL)
 SELECT CAST(range AS BIGINT) AS id, {r('sqrt(c * c + s * s)', 'resultant', 5)} FROM s""",
)
def phase_resultant(spark, d):
    grid = spark.range(21).select("id", (F.lit(0.0009) + F.col("id") * 0.00001).alias("freq_hz"))
    shifted = pulses(spark, d).withColumn("toa_s", F.col("toa_s") - 1.7e9)
    return rounded(intervals.resultants(shifted, grid).select("id", "resultant"), 5)


@register(
    "channel_map_join",
    f"WITH {PULSES_SQL} SELECT antenna, count(*) AS n, {r('avg(peak_v)', 'mean_v')} FROM pulses LEFT JOIN (VALUES {', '.join(str((k, v)) for k, v in ANTENNAS.items())}) m(channel, antenna) USING (channel) GROUP BY antenna",
)
def channel_map_join(spark, d):
    joined = campaign.channel_map(pulses(spark, d), ANTENNAS)
    return rounded(joined.groupBy("antenna").agg(F.count("*").alias("n"), F.avg("peak_v").alias("mean_v")))


@register(
    "group_summary",
    f"""{_ROLLING} SELECT channel, count(*) AS n_events, count(valid_dt) AS n_valid_events, count(*) FILTER (WHERE is_outlier) AS n_outliers, {r('coalesce(quantile_cont(valid_dt, 0.5), 0)', 'median_dt', 3)},
 {r('coalesce(quantile_cont(valid_dt, 0.75) - quantile_cont(valid_dt, 0.25), 0)', 'iqr_dt', 3)}, {r('coalesce(quantile_cont(valid_dt, 0.9), 0)', 'p90_dt', 3)},
 {r('stddev_samp(valid_dt) / avg(valid_dt)', 'cv_dt')}, {r('coalesce(avg(rolling_rate_hz), 0)', 'mean_smoothed_rate', 9)} FROM rolled GROUP BY channel""",
)
def group_summary(spark, d):
    out = campaign.group_summary(rolling.rolling_rates(_flagged(spark, d), ROWS), "channel")
    return rounded(rounded(rounded(out, 3, "median_dt", "iqr_dt", "p90_dt"), 6, "cv_dt"), 9, "mean_smoothed_rate")


@register(
    "sensitivity_grid",
    f"""WITH {PULSES_SQL}, lim AS (SELECT series_id, avg(peak_v) AS m, stddev_pop(peak_v) AS s FROM pulses GROUP BY series_id), ks AS (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS k_sigma),
 gaps AS (SELECT k_sigma, toa_s - lag(toa_s) OVER (PARTITION BY series_id, k_sigma ORDER BY k) AS dt FROM pulses JOIN lim USING (series_id), ks WHERE peak_v >= m + k_sigma * s)
 SELECT k_sigma, max_valid_dt_s, count(*) AS total_events, count(*) FILTER (WHERE dt <= max_valid_dt_s) AS valid_events, count(*) FILTER (WHERE dt > max_valid_dt_s) AS outliers
 FROM gaps, (SELECT unnest([20000.0, 50000.0, 100000.0]::DOUBLE[]) AS max_valid_dt_s) WHERE dt IS NOT NULL GROUP BY ALL""",
)
def sensitivity_grid(spark, d):
    return campaign.sensitivity_grid(pulses(spark, d), [0.0, 0.5, 1.0], [2e4, 5e4, 1e5])
