"""Bursts by typed state and timers against a loop over all pulses."""

import os
import time

import numpy as np
import pandas as pd
import pytest

from pulseloom.streaming import stateful, tracking

IDLE = 50.0


def written(path, batches):
    """Event files, read one after the other."""
    for i, rows in enumerate(batches):
        pdf = pd.DataFrame(rows, columns=["event_id", "toa_s", "user_id", "event_type"])
        pdf["ts"] = pd.to_datetime((pdf.pop("toa_s") * 1e6).round().astype("int64"), unit="us").astype("datetime64[us]")
        pdf = pdf.assign(value=1.0, props="")[["event_id", "ts", "user_id", "event_type", "value", "props"]]
        name = path / f"events.parquet-{i}.parquet"
        pdf.to_parquet(name, index=False)
        os.utime(name, (time.time() - 100 + i, time.time() - 100 + i))
    return str(path)


def slow(rows, q=1e8, r=1e8, p0=1e8, alpha=0.2, last=10):
    """(series, start) -> closed and open bursts of pulses (event, t, series, channel)."""
    out, by = {}, {}
    for _, t, s, c in sorted(rows, key=lambda x: (x[1], x[0])):
        b = by.get(s)
        if b is None or t - b["end"] > IDLE:
            b = by[s] = out[s, t] = {"end": t, "n": 0, "x": None, "p": p0, "s": None, "z": [], "c": set()}
        else:
            z = t - b["end"]
            x = z if b["x"] is None else b["x"]
            ahead = b["p"] + q
            gain = ahead / (ahead + r)
            b.update(end=t, x=x + gain * (z - x), p=(1 - gain) * ahead, s=z if b["s"] is None else alpha * z + (1 - alpha) * b["s"], z=[*b["z"], z][-last:])
        b["n"] += 1
        b["c"].add(c)
    return out


def checked(got, want):
    assert {(r["series_id"], round(r["start_s"], 3)) for r in got} == {(s, round(t, 3)) for s, t in want}
    for r in got:
        b = next(v for (s, t), v in want.items() if s == r["series_id"] and abs(t - r["start_s"]) < 1e-3)
        assert (r["n"], r["channels"]) == (b["n"], len(b["c"])) and abs(r["end_s"] - b["end"]) < 1e-3
        mean = float(np.mean(b["z"])) if b["z"] else None
        for name, value in (("kalman_filtered", b["x"]), ("ewma", b["s"]), ("sma", mean)):
            assert (r[name] is None) == (value is None) and (value is None or abs(r[name] - value) < 1e-5), name


def pulses(seed, n=300, series=6, span=8000.0, at=1_700_000_000.0):
    r = np.random.default_rng(seed)
    times = np.sort(r.uniform(0, span, n)).round(3) + at
    return [(i, float(t), int(r.integers(series)), str(r.choice(["a", "b"]))) for i, t in enumerate(times)]


@pytest.mark.parametrize("files", [1, 3])
def test_idle_series_are_closed_by_timers(spark, tmp_path, files):
    rows = pulses(1)
    cut = [rows[i * len(rows) // files : (i + 1) * len(rows) // files] for i in range(files)]
    source = lambda p: stateful.bursts(IDLE)(p)
    got = tracking.replay(spark, written(tmp_path, cut), source).collect()
    final = max(t for _, t, *_ in rows) - 3600  # the watermark's delay
    want = slow(rows)
    by_timer = {k for k, b in want.items() if b["end"] + IDLE < final - 1}
    by_next = {k for k, b in want.items() if any(s == k[0] and t > b["end"] + IDLE for _, t, s, _ in rows)}
    checked(got, {k: want[k] for k in by_timer | by_next})
    assert files > 1 or by_timer - by_next  # a series' last burst has no next pulse


def test_a_series_that_stops_gives_its_row(spark, tmp_path):
    rows = [(1, 1e9, 1, "a"), (2, 1e9 + 10, 1, "b"), (3, 1e9 + 9000, 2, "a")]
    got = tracking.replay(spark, written(tmp_path, [rows[:2], rows[2:]]), stateful.bursts(IDLE)).collect()
    assert [(r["series_id"], r["n"], r["channels"]) for r in got] == [(1, 2, 2)]


def test_state_comes_from_a_batch_run(spark, tmp_path):
    """The first half in a batch, the second one streamed, give what all of it streamed gives."""
    rows = pulses(3, 400, 4, 6000.0)
    half = spark.createDataFrame([(s, e, t, c) for e, t, s, c in rows[:200]], "series_id long, k long, toa_s double, channel string")
    initial = stateful.open_bursts(half, IDLE)
    got = tracking.replay(spark, written(tmp_path, [rows[200:]]), stateful.bursts(IDLE, initial=initial)).collect()
    before, want = slow(rows[:200]), slow(rows)
    ended = {k for k, b in want.items() if any(s == k[0] and t > b["end"] + IDLE for _, t, s, _ in rows) or b["end"] + IDLE < rows[-1][1] - 3601}
    closed_in_batch = {k for k in before if any(s == k[0] and s2 > k[1] for s, s2 in before)}
    checked(got, {k: want[k] for k in ended - closed_in_batch})
