"""Window verdicts as plans against one window at a time in numpy."""

import numpy as np
import pytest

from pulseloom.functions import dsp
from pulseloom.operators import decide
from pulseloom.operators.features import EPS, NAMES


def table(x, size, overlap):
    w = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - overlap]
    a, d = np.abs(w), w - w.mean(1, keepdims=True)
    var, rms, energy = (d**2).mean(1), np.sqrt((w**2).mean(1)), (w**2).sum(1)
    p = w**2 / (energy[:, None] + EPS)
    values = [
        var, (d**4).mean(1) / var**2, (d**3).mean(1) / var**1.5, rms, rms / a.mean(1), a.max(1) / rms, a.max(1) / a.mean(1), a.max(1) / np.sqrt(a).mean(1) ** 2,
        -(p * np.log2(p + EPS)).sum(1), energy, (np.diff(np.sign(w), axis=1) != 0).sum(1) / (size - 1), np.subtract(*np.percentile(w, [75, 25], axis=1)),
    ]
    return dict(zip(NAMES, values))


def alarms_of(v, threshold, drift):
    mu, up, down, out = v[:200].mean(), 0.0, 0.0, [False]
    for x in v[1:]:
        up, down = max(0.0, up + x - mu - drift), max(0.0, down - x + mu - drift)
        out.append(up > threshold or down > threshold)
    return out


def one(x, fs, k, threshold, drift, n_max=20):
    y = dsp.denoise(x, "db4", "soft", "universal")
    pulses = dsp.detect(y, fs, k)
    n = len(pulses)
    if n < 3:
        return False, 0.0, n if n == 2 else 0, 0.0, "none"
    alarms = alarms_of(np.diff(pulses) / fs, threshold, drift)
    half = len(alarms) // 2
    far = sum(alarms[:half]) / max(half, 1)
    best, dominant = -np.inf, "none"
    for name, v in table(y, min(256, len(x) // 2), min(128, len(x) // 4)).items():
        value = round(float((((v - v.mean()) / v.std()) ** 4).mean()), 9) if v.std() > 0 else -np.inf
        if value > best:
            best, dominant = value, name
    return True, min(n / n_max, 1.0) * (1 - far), n, far, dominant


@pytest.mark.parametrize(("size", "step"), [(1024, 1024), (1024, 700), (128, 128)])
def test_verdicts_equal_one_window_at_a_time(spark, size, step):
    r = np.random.default_rng(5)
    series = [r.normal(0, 1, 4200) + 12 * (r.random(4200) > 0.98) * (np.arange(4200) > 800) for _ in range(3)] + [r.normal(0, 1, 50)]
    rows = [(s, i, float(v)) for s, x in enumerate(series) for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "series_id long, idx long, x double").repartition(4)
    fs, k, threshold, drift = 1.0, 2.0, 60.0, 3.0
    got = decide.campaign_verdicts(samples, fs, size, size - step, k=k, threshold=threshold, drift=drift).collect()
    expected = {(s, w): one(x[w * step : w * step + size], fs, k, threshold, drift) for s, x in enumerate(series) for w in range((len(x) - size) // step + 1 if len(x) >= size else 0)}
    assert {(g["series_id"], g["win_id"]) for g in got} == set(expected) and len(got) == len(expected)
    for g in got:
        present, confidence, n, far, dominant = expected[g["series_id"], g["win_id"]]
        assert (g["pd_present"], g["n_events"], g["dominant_descriptor"]) == (present, n, dominant)
        assert g["confidence"] == pytest.approx(confidence, abs=6e-5) and g["far_estimate"] == pytest.approx(far, abs=6e-5)
        assert (g["t_start"], g["t_end"]) == (g["win_id"] * step / fs, (g["win_id"] * step + size) / fs)
    if size == 1024:
        assert any(e[3] > 0 for e in expected.values()) and len({e[4] for e in expected.values()}) > 2


def test_windows_without_pulses_are_absent_and_no_window_sums_to_zero(spark):
    flat = spark.range(256).selectExpr("0L AS series_id", "id AS idx", "0D AS x")
    got = decide.campaign_verdicts(flat, 1.0, 128).collect()
    assert [tuple(g)[4:] for g in got] == [(False, 0.0, 0, 0.0, "none")] * 2
    none = decide.campaign_summary(decide.campaign_verdicts(flat.limit(20), 1.0, 128)).first()
    assert (none["total_windows"], none["pd_present_pct"], none["mean_confidence"], none["first_detection_s"], none["false_alarm_rate_per_min"]) == (0, 0.0, 0.0, None, 0.0)


#: Signs of waveforms that have windows exactly 1.5 deviations from the early ones' mean: samples, and a bit each.
TIED = {
    933: (607, 0x4ca72bd014d339215e584700f2a4db2870d2653bcdca286714f9ef7e04e9154fa2f612c1eb69989c8158236986582966cb5335db5476ec6f1317c9a456a65e8e92db6d60f5f41f51d7cb174),
    459: (588, 0x1b7de8516b2b10a96b936b9895d9e1b92d968e192449cc37bc912005c935339a8b44f384b6c220c78019c6d22b6365826e07f2e96fc9a02b40ca222153c9dde9edd757ae0c980913146),
    102: (628, 0x66804b5d41638b44c7e125a944e3f3d83a95c0aa1cdecb8aad19fdf550de56580b97e6cc9431ebba00e0dff6a1b1ba973ebedc10b9865ef0b4512f74c4b05e6b651fb3812c02ff2c50ea1e55fc1f3),
    235: (623, 0x297889c2570587b350f82712e850982c5b4d515f80bf528855c4a340784a3354ac8bd26b9d42357f3fb9a790b57640b8a536b6a584aa2a165f3508cfea419f5095c61135c2d14067385fc36a9ebe),
    190: (588, 0xbe9b94e41682a6be9102d9be91ca4d6daef15ddcbe56bd01ce31acf9a55e9c1a15ce0e72adb5329829d224cfbac32791cf2f6e520ddc1cbf6f56ff3b46f10e75448c363ca0af1dba014),
    967: (632, 0x46a9719565c3104e5de8bce9f37a32062d76e0eb24bfe43c511cb9d4e5587f4a2aec5148f98ab66b146d33974432c4708e98052245214b76e005665a3d3adb4c64d10256b45beb46895576d696d271),
}


def test_windows_exactly_at_the_limit_of_sign_changes_are_no_alarms(spark):
    """In sums of shares the order of windows decided on them."""
    x = {s: [1.0 if bits >> (n - 1 - i) & 1 else -1.0 for i in range(n)] for s, (n, bits) in TIED.items()}
    df = spark.createDataFrame([(s, i, v) for s, xs in x.items() for i, v in enumerate(xs)], "series_id long, idx long, x double")
    got = {(g["series_id"], g["win_id"]): g["alarm"] for g in decide.zcr_alarms(df, 64, 0.5, 1.5).collect()}
    ties = 0
    for s, xs in x.items():
        changes = [sum(xs[i] != xs[i - 1] for i in range(w * 32 + 1, w * 32 + 64)) for w in range((len(xs) - 64) // 32 + 1)]
        early = [c for w, c in enumerate(changes) if w * 32 + 64 <= len(xs) // 2]
        n, total, squares = len(early), sum(early), sum(c * c for c in early)
        for w, c in enumerate(changes):
            away, limit = 4 * (n * c - total) ** 2, 9 * (n * squares - total**2)
            ties += away == limit
            assert got[s, w] == (away > limit), (s, w)
    assert ties >= 5
