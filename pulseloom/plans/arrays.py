"""Queries over array segments (embeddings), synthetic signals, studies and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from pulseloom.operators import campaign, detect, studies
from pulseloom.plans.catalog import register
from pulseloom.plans.common import r, rounded
from pulseloom.sources.tables import INTERVALS_SQL, PULSES_SQL, segments

FS = 1e9
BANDS = [(0.0, 0.1), (0.1, 0.3), (0.3, 0.6)]
_N = 64

_SPEC = f"""WITH s AS (SELECT vec_id AS series_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT series_id, i, x - avg(x) OVER (PARTITION BY series_id) AS x FROM s),
 f AS (SELECT range AS f_no FROM range({_N // 2 + 1})),
 spec AS (SELECT series_id, f_no, f_no * {FS / _N}::DOUBLE AS f_hz, (power(sum(x * cos(2 * pi() * f_no * i / {_N})), 2) + power(sum(x * sin(2 * pi() * f_no * i / {_N})), 2)) / {_N} AS psd FROM c, f GROUP BY ALL)"""


@register("spectrum", f"{_SPEC} SELECT series_id, f_no, {r('f_hz', digits=1)}, {r('psd')} FROM spec")
def spectrum(spark, d):
    out = campaign.spectrum(segments(spark, d), FS)
    return rounded(rounded(out, 1, "f_hz"), 6, "psd")


def _band_sql(low: float, high: float) -> str:
    return f"coalesce(sum(CASE WHEN f_hz >= {low * 1e9} AND pf >= {low * 1e9} AND f_hz < {high * 1e9} THEN (psd + pp) / 2 * (f_hz - pf) END), 0)"


_NAMES = [campaign.band_name(*b) for b in BANDS]
_BANDS = (
    _SPEC
    + ", l AS (SELECT *, lag(f_hz) OVER w AS pf, lag(psd) OVER w AS pp FROM spec WINDOW w AS (PARTITION BY series_id ORDER BY f_no)), b AS (SELECT series_id, sum((psd + pp) / 2 * (f_hz - pf)) AS spectral_total_power, "
    + ", ".join(f"{_band_sql(*b)} AS {n}" for b, n in zip(BANDS, _NAMES))
    + ", sum(f_hz * psd) / sum(psd) AS spectral_centroid_hz FROM l GROUP BY series_id)"
)


@register(
    "spectral_metrics",
    f"{_BANDS} SELECT series_id, {r('spectral_total_power', digits=0)}, {', '.join(r(n, digits=0) for n in _NAMES)}, {', '.join(r(f'{n} / spectral_total_power', f'{n}_share', 6) for n in _NAMES)}, {r('spectral_centroid_hz', digits=0)}, {r(f'{_NAMES[-1]} / {_NAMES[0]}', 'ratio_high_low', 5)} FROM b",
)
def spectral_metrics(spark, d):
    out = campaign.spectral_metrics(campaign.spectrum(segments(spark, d), FS), BANDS)
    out = rounded(out, 0, "spectral_total_power", *_NAMES, "spectral_centroid_hz")
    return rounded(rounded(out, 6, *[f"{n}_share" for n in _NAMES]), 5, "ratio_high_low")


def _summary(df):
    """A row for each segment: length, energy and extremes of its samples."""
    return detect.to_long(df).groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("energy"), F.min("x").alias("low"), F.max("x").alias("high"))


@register("wavelet_denoise")
def wavelet_denoise(spark, d):
    return _summary(detect.denoise(segments(spark, d), "db4", "soft", "universal"))


_X = "x AS (SELECT vec_id AS series_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_SUMS = f"count(*) AS n, {r('sum(x * x)', 'energy')}, {r('min(x)', 'low')}, {r('max(x)', 'high')}"


@register(
    "hilbert_envelope",
    f"""WITH {_X}, h AS (SELECT a.series_id, a.i, any_value(a.x) AS x, sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.x * 2 / {_N} / tan(pi() * (a.i - b.i) / {_N}) ELSE 0 END) AS h FROM x a JOIN x b USING (series_id) GROUP BY ALL),
 e AS (SELECT series_id, sqrt(x * x + h * h) AS x FROM h) SELECT series_id, {_SUMS} FROM e GROUP BY series_id""",
)
def hilbert_envelope(spark, d):
    return rounded(_summary(detect.envelope(segments(spark, d))))


@register("bandpass_filter")
def bandpass_filter(spark, d):
    return _summary(detect.bandpass(segments(spark, d), FS, 50e6, 300e6))


_TAPS = 8


@register(
    "lms_noise_canceller",
    f"""WITH RECURSIVE v AS (SELECT vec_id AS series_id, embedding::DOUBLE[] AS x FROM embeddings),
 f AS (SELECT series_id, {_TAPS - 1} AS i, x, 0::DOUBLE AS e, list_transform(range({_TAPS}), lambda j: 0::DOUBLE) AS w, list_transform(range({_TAPS}), lambda j: 0::DOUBLE) AS past FROM v
  UNION ALL SELECT series_id, i, x, e, list_transform(range({_TAPS}), lambda j: w[j + 1] + 2 * 0.01 * e * past[j + 1]), past FROM (
   SELECT series_id, i, x, w, past, x[i + 1] - list_dot_product(w, past) AS e FROM (
    SELECT series_id, i + 1 AS i, x, w, list_transform(range({_TAPS}), lambda j: x[(i - j - {_TAPS} + {_N}) % {_N} + 1]) AS past FROM f WHERE i + 1 < {_N}))),
 o AS (SELECT series_id, e AS x FROM f WHERE i >= {_TAPS} UNION ALL SELECT series_id, 0 FROM v, range({_TAPS})) SELECT series_id, {_SUMS} FROM o GROUP BY series_id""",
)
def lms_noise_canceller(spark, d):
    return rounded(_summary(detect.cancel_noise(segments(spark, d), 0.01, _TAPS)))


@register("preprocess_chain")
def preprocess_chain(spark, d):
    return _summary(detect.preprocess(segments(spark, d), FS, 50e6, 300e6, True, True, True))


@register("distance_peaks")
def distance_peaks(spark, d):
    return detect.array_pulses(segments(spark, d), FS, 1.0, 5e-9)


_PEAKS = f"""WITH {_X}, m AS (SELECT series_id, i, abs(x) AS m, avg(abs(x)) OVER (PARTITION BY series_id) AS mu, stddev_pop(abs(x)) OVER (PARTITION BY series_id) AS s FROM x),
 p AS (SELECT * FROM (SELECT *, lag(m) OVER w AS before, lead(m) OVER w AS behind FROM m WINDOW w AS (PARTITION BY series_id ORDER BY i)) WHERE m > before AND m > behind)"""


@register(
    "prominence_peaks",
    f"""{_PEAKS}, r AS (SELECT p.series_id, p.i, p.m, p.s, coalesce(max(m.i) FILTER (WHERE m.i < p.i AND m.m > p.m), -1) AS a, coalesce(min(m.i) FILTER (WHERE m.i > p.i AND m.m > p.m), {_N}) AS b FROM p JOIN m USING (series_id) GROUP BY ALL),
 q AS (SELECT r.series_id, r.i, r.m, r.s, greatest(min(m.m) FILTER (WHERE m.i > a AND m.i <= r.i), min(m.m) FILTER (WHERE m.i >= r.i AND m.i < b)) AS base FROM r JOIN m USING (series_id) GROUP BY ALL)
 SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS pulse_no, i AS idx, {r('m', 'peak_v')} FROM q WHERE m - base >= 1.5 * s""",
)
def prominence_peaks(spark, d):
    return rounded(detect.array_pulses(segments(spark, d), FS, 3.0, 0.0, "prominence"))


@register("pulse_morphology")
def pulse_morphology(spark, d):
    return detect.pulse_shapes(segments(spark, d), FS, 1.0)


@register("synthetic_signals")
def synthetic_signals(spark, d):
    return _summary(studies.synthetic_signals(spark, 8).select("series_id", "samples"))


@register("denoising_grid")
def denoising_grid(spark, d):
    return studies.denoising_grid(spark)


@register("denoising_best_cell")
def denoising_best_cell(spark, d):
    return studies.best_cell(studies.denoising_grid(spark))


@register("snr_study")
def snr_study(spark, d):
    return studies.snr_study(spark)


@register("convergence_study")
def convergence_study(spark, d):
    return studies.convergence_study(spark)


@register("stream_delta_t", f"WITH {INTERVALS_SQL} SELECT series_id, event_id, {r('delta_t_s')} FROM intervals")
def stream_delta_t(spark, d):
    from pulseloom.streaming import tracking

    return rounded(tracking.replay(spark, d, tracking.delta_t).select("series_id", "event_id", "delta_t_s"))


@register(
    "stream_kalman",
    f"""WITH RECURSIVE {INTERVALS_SQL}, f AS (
  SELECT series_id, k, event_id, delta_t_s AS z, delta_t_s AS x, 2e8 * 1e8 / 3e8 AS p, 0::DOUBLE AS score, delta_t_s AS s, 0::DOUBLE AS up, 0::DOUBLE AS down FROM intervals WHERE k = 0
  UNION ALL SELECT series_id, k, event_id, z, x + p / (p + 1e8) * (z - x), p * 1e8 / (p + 1e8), (z - x) / sqrt(p + 1e8), s, up, down FROM (
   SELECT i.series_id, i.k, i.event_id, i.delta_t_s AS z, CASE WHEN i.delta_t_s > 60000 THEN i.delta_t_s ELSE f.x END AS x, CASE WHEN i.delta_t_s > 60000 THEN 1e8 ELSE f.p END + 1e8 AS p, 0.2 * i.delta_t_s + 0.8 * f.s AS s,
    greatest(0, f.up + i.delta_t_s - 31000) AS up, greatest(0, f.down - i.delta_t_s + 29000) AS down FROM f JOIN intervals i ON i.series_id = f.series_id AND i.k = f.k + 1))
 SELECT series_id, event_id, {r('z', 'delta_t_s', 3)}, {r('x', 'kalman_filtered', 3)}, {r('score', 'kalman_z')}, {r('s', 'ewma', 3)}, {r('up', 'g_plus', 3)}, {r('down', 'g_minus', 3)}, up > 100000 OR down > 100000 AS alarm FROM f""",
)
def stream_kalman(spark, d):
    from pulseloom.streaming import tracking

    out = tracking.replay(spark, d, tracking.trackers)
    return rounded(rounded(out, 3, "delta_t_s", "kalman_filtered", "ewma", "g_plus", "g_minus"), 6, "kalman_z")


_DAY = 86_400


@register(
    "stream_window_counts",
    f"SELECT event_type AS channel, CAST(floor(epoch(ts) / {_DAY}) * {_DAY} AS BIGINT) AS start_s, count(*) AS n, {r('sum(value)', 'total', 4)} FROM events GROUP BY ALL",
)
def stream_window_counts(spark, d):
    from pulseloom.streaming import tracking

    return rounded(tracking.replay(spark, d, tracking.window_counts, keys=("channel", "start_s")), 4)




def _bursts_sql(gap: float, strict: bool) -> str:
    """Pulses with the number of their burst: a pause above the gap (or of the gap too) begins a new one."""
    pause = ">" if strict else ">="
    return f"""{PULSES_SQL}, gaps AS (SELECT *, toa_s - lag(toa_s) OVER (PARTITION BY series_id ORDER BY k) AS z FROM pulses),
 runs AS (SELECT *, sum(CASE WHEN z IS NULL OR z {pause} {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY k) AS run FROM gaps),
 placed AS (SELECT *, row_number() OVER (PARTITION BY series_id, run ORDER BY k) - 1 AS i, max(run) OVER (PARTITION BY series_id) AS runs FROM runs),
 mark AS (SELECT max(toa_s) - 3600 AS w FROM pulses)"""


_IDLE, _STEADY = 86_400.0, 1e8


@register(
    "stream_bursts",
    f"""WITH RECURSIVE {_bursts_sql(_IDLE, True)},
 f AS (SELECT series_id, run, i, 0.0::DOUBLE AS x, {_STEADY}::DOUBLE AS p, 0.0::DOUBLE AS s FROM placed WHERE i = 0 UNION ALL
 SELECT b.series_id, b.run, b.i, CASE WHEN b.i = 1 THEN b.z ELSE f.x + (f.p + {_STEADY}) / (f.p + 2 * {_STEADY}) * (b.z - f.x) END, {_STEADY} * (f.p + {_STEADY}) / (f.p + 2 * {_STEADY}),
 CASE WHEN b.i = 1 THEN b.z ELSE 0.2 * b.z + 0.8 * f.s END FROM f JOIN placed b ON b.series_id = f.series_id AND b.run = f.run AND b.i = f.i + 1),
 ends AS (SELECT series_id, run, min(toa_s) AS a, max(toa_s) AS b, count(*) AS n, count(DISTINCT channel) AS channels, any_value(runs) AS runs FROM placed GROUP BY ALL),
 means AS (SELECT series_id, run, avg(z) AS sma FROM placed JOIN ends USING (series_id, run) WHERE i > 0 AND i >= n - 10 GROUP BY ALL)
 SELECT e.series_id, {r('a', 'start_s', 3)}, {r('b', 'end_s', 3)}, n, channels, {r('CASE WHEN n > 1 THEN x END', 'kalman_filtered', 3)}, {r('CASE WHEN n > 1 THEN s END', 'ewma', 3)}, {r('sma', digits=3)}
 FROM ends e JOIN f ON f.series_id = e.series_id AND f.run = e.run AND f.i = n - 1 LEFT JOIN means ON means.series_id = e.series_id AND means.run = e.run, mark WHERE e.run < e.runs OR b + {_IDLE} < w""",
)
def stream_bursts(spark, d):
    from pulseloom.streaming import stateful, tracking

    return rounded(tracking.replay(spark, d, stateful.bursts(_IDLE, _STEADY, _STEADY, _STEADY)), 3)


@register(
    "stream_sessions",
    f"""WITH {_bursts_sql(_DAY, False)}, ends AS (SELECT series_id, run, min(toa_s) AS a, max(toa_s) AS b, count(*) AS n FROM placed GROUP BY ALL)
 SELECT series_id, CAST(floor(a) AS BIGINT) AS start_s, CAST(floor(b + {_DAY}) AS BIGINT) AS end_s, n FROM ends, mark WHERE b + {_DAY} <= w""",
)
def stream_sessions(spark, d):
    from pulseloom.streaming import tracking

    return tracking.replay(spark, d, lambda p: tracking.sessions(p, "1 day"))


@register("stream_simple_trackers")
def stream_simple_trackers(spark, d):
    from pulseloom.streaming import tracking

    return tracking.replay(spark, d, tracking.simple_trackers)


@register(
    "stream_sliding_counts",
    f"WITH w AS (SELECT event_type AS channel, floor(epoch(ts) / {_DAY // 2}) * {_DAY // 2} AS s, value FROM events), b AS (SELECT channel, s, value FROM w UNION ALL SELECT channel, s - {_DAY // 2}, value FROM w)\n SELECT channel, CAST(s AS BIGINT) AS start_s, count(*) AS n, {r('sum(value)', 'total', 4)} FROM b GROUP BY ALL",
)
def stream_sliding_counts(spark, d):
    from pulseloom.streaming import tracking

    return rounded(tracking.replay(spark, d, lambda p: tracking.window_counts(p, "1 day", "12 hours"), keys=("channel", "start_s")), 4)


@register(
    "delta_t_vector",
    f"""{_PEAKS} SELECT series_id, no - 2 AS k, {r(f'dt / {FS}', 'delta_t_s', 12)} FROM (SELECT series_id, row_number() OVER w AS no, i - lag(i) OVER w AS dt FROM p WHERE m >= mu + s WINDOW w AS (PARTITION BY series_id ORDER BY i)) WHERE no > 1""",
)
def delta_t_vector(spark, d):
    return rounded(detect.delta_t_vector(segments(spark, d), FS, 1.0), 12)
