"""Joined and deduplicated streams over several batches, with late and repeated rows."""

import pytest

from pulseloom.operators import campaign
from pulseloom.streaming import tracking
from tests.test_stateful import pulses, written

DAY = 100.0


def cut(rows, files):
    return [rows[i * len(rows) // files : (i + 1) * len(rows) // files] for i in range(files)]


def near(rows):
    marks = [x for x in rows if x[3] == "b"]
    return {(p[0], m[0]) for p in rows for m in marks if m[2] == p[2] and p[1] - DAY <= m[1] <= p[1]}


def joined(spark, path, how):
    marks = tracking.source(spark, path, 1, "events.parquet*").filter("channel = 'b'")
    return tracking.replay(spark, path, lambda p: tracking.stage_events(p, marks, f"{DAY:g} seconds", how)).collect()


@pytest.mark.parametrize("files", [1, 4])
def test_inner_join_is_the_batch_join(spark, tmp_path, files):
    rows = pulses(11)
    got = joined(spark, written(tmp_path, cut(rows, files)), "inner")
    want = near(rows)
    assert len(got) == len(want) and {(r["event_id"], r["mark_id"]) for r in got} == want
    times = {x[0]: x[1] for x in rows}
    assert all(abs(r["since_mark_s"] - (times[r["event_id"]] - times[r["mark_id"]])) < 1e-5 for r in got)


def test_marks_may_come_later_than_their_pulses(spark, tmp_path):
    """Within the watermark's delay the order of arrival does not matter."""
    rows = pulses(12, span=3000.0)
    late = [[x for x in rows if x[3] == "a"], [x for x in rows if x[3] == "b"]]
    assert {(r["event_id"], r["mark_id"]) for r in joined(spark, written(tmp_path, late), "inner")} == near(rows)


def test_unmatched_pulses_are_given_once_they_are_final(spark, tmp_path):
    rows = pulses(13, span=20_000.0)
    got = joined(spark, written(tmp_path, cut(rows, 3)), "left")
    want, found = near(rows), {(r["event_id"], r["mark_id"]) for r in got}
    assert {x for x in found if x[1] is not None} == want
    matched = {p for p, _ in want}
    final = max(x[1] for x in rows if x[3] == "b") - 3600
    assert {p for p, m in found if m is None} == {x[0] for x in rows if x[0] not in matched and x[1] < final}
    assert len(got) == len(found)


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    rows = pulses(14, span=3000.0)
    path = written(tmp_path, [rows[:200], rows[100:300] + rows[100:150], rows[250:]])
    got = tracking.replay(spark, path, tracking.without_repeats).collect()
    assert sorted(r["event_id"] for r in got) == sorted(x[0] for x in rows)


def test_thresholds_detect_anew_as_the_array_kernel_does(spark):
    import numpy as np

    r = np.random.default_rng(15)
    waves = {1: r.normal(0, 1, 600), 2: r.integers(-3, 4, 500).astype(float), 3: np.zeros(50), 4: r.normal(0, 1, 4)}
    arrays = spark.createDataFrame([(s, x.tolist(), 1e3) for s, x in waves.items()], "series_id long, samples array<double>, fs_hz double")
    samples = spark.createDataFrame([(s, i, float(v)) for s, x in waves.items() for i, v in enumerate(x)], "series_id long, idx long, x double").repartition(5)
    ks, cuts = [0.5, 1.0, 2.0], [0.0045, 0.0205]
    order = ["series_id", "k_sigma", "max_valid_dt_s", "total_events", "valid_events", "outliers"]
    rows = lambda df: sorted(tuple(x[c] for c in order) for x in df.collect())
    got = rows(campaign.threshold_sensitivity(samples, ks, cuts, 1e3))
    assert got == rows(campaign.detection_sensitivity(arrays, ks, cuts)) and len(got) >= 10
