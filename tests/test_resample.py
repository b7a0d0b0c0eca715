"""Poisson bootstrap against the plain one and against drawing for every row."""

import time

import numpy as np
import pandas as pd
import pytest

from pulseloom.operators import hypothesis, quantiles, resample


def frame(spark, data):
    return spark.createDataFrame(pd.concat(pd.DataFrame({"series_id": s, "v": x}) for s, x in data.items())).repartition(5)


def plain(x, share, resamples, seed):
    """Lower weighted quantiles of Poisson resamples, a number for each row."""
    x, r = np.sort(x), np.random.default_rng(seed)
    upto = np.cumsum(r.poisson(1, (resamples, len(x))), axis=1)
    upto = upto[upto[:, -1] > 0]
    return x[(upto < np.maximum(1, np.ceil(share * upto[:, -1:]))).sum(axis=1)]


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_intervals_agree_with_a_draw_for_each_row(spark, monkeypatch, share):
    """Values far from the quantile count together, values of one number of rows too."""
    monkeypatch.setattr(resample, "SMALL", 300)
    monkeypatch.setattr(quantiles, "ROWS", 500)
    monkeypatch.setattr(resample, "DRAWS", 1 << 17)
    r = np.random.default_rng(2)
    data = {1: r.exponential(3, 3000), 2: r.integers(0, 6, 1000).astype(float), -3: r.normal(0, 1, 40), 4: np.array([2.5]), 5: np.full(700, 1.0)}
    got = {x["series_id"]: x for x in resample.poisson_bootstrap(frame(spark, data), "v", share, 2000).collect()}
    assert set(got) == set(data)
    for s, x in data.items():
        row, found = got[s], plain(x, share, 4000, 5)
        assert row["n"] == len(x) and np.isclose(row["estimate"], np.quantile(x, share))
        error = 4 * (np.quantile(found, 0.985) - np.quantile(found, 0.965) + np.quantile(found, 0.035) - np.quantile(found, 0.015)) + 1e-12
        assert abs(row["ci_low"] - np.quantile(found, 0.025)) <= error and abs(row["ci_high"] - np.quantile(found, 0.975)) <= error, s
        assert row["ci_low"] <= row["ci_high"]


def test_agrees_with_the_percentile_bootstrap(spark):
    data = {s: np.random.default_rng(s).exponential(3, 400) for s in (1, 2)}
    df = frame(spark, data)
    got = {x["series_id"]: x for x in resample.poisson_bootstrap(df, "v", resamples=3000).collect()}
    for x in hypothesis.bootstrap(df, "v", resamples=3000).collect():
        width = x["ci_high"] - x["ci_low"]
        assert abs(got[x["series_id"]]["ci_low"] - x["ci_low"]) < 0.15 * width and abs(got[x["series_id"]]["ci_high"] - x["ci_high"]) < 0.15 * width


def test_reruns_agree_and_odd_rows_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 5.0), (1, None), (1, float("nan")), (2, None), (3, float("inf"))], "series_id long, v double")
    first = resample.poisson_bootstrap(df, "v", resamples=200).collect()
    assert first == resample.poisson_bootstrap(df.repartition(3), "v", resamples=200).collect()
    assert [(x["series_id"], x["n"], x["estimate"]) for x in first] == [(1, 3, 2.0)]
    assert resample.poisson_bootstrap(df.limit(0), "v").count() == 0


def test_ranks_of_resamples_are_those_of_drawn_rows():
    """Medians, quartiles and means of resamples, against a draw for each row; odd and even counts, ties, one row."""
    for n in (1, 2, 3, 10, 67):
        x = np.sort(np.random.default_rng(n).exponential(3, n).round(1))
        drawn = x[np.random.default_rng(1).integers(0, n, (40_000, n))]
        expected = {np.median: np.median(drawn, axis=1), hypothesis.iqr: np.subtract(*np.percentile(drawn, [75, 25], axis=1)), np.mean: drawn.mean(axis=1)}
        for statistic, other in expected.items():
            found = hypothesis._resampled(x, statistic, 40_000, np.random.default_rng(2))
            values = np.union1d(found.round(9), other.round(9))
            share = lambda y: np.searchsorted(np.sort(y.round(9)), values, "right") / len(y)
            assert np.abs(share(found) - share(other)).max() < 0.015, (n, statistic)


def test_a_report_draws_in_time(spark):
    """The whole resamples of 300 series of 60 rows, medians, quartile ranges and mean rates; a call for each resample took minutes."""
    r = np.random.default_rng(3)
    df = frame(spark, {s: r.exponential(3, 60) for s in range(300)})
    begin = time.monotonic()
    rows = hypothesis._intervals(df, "v", {"m_": np.median, "i_": hypothesis.iqr, "r_": hypothesis.mean_rate}, 10_000, 0.95, [1, 2, 3]).collect()
    assert len(rows) == 300 and all(x[f"{p}_ci_low"] < x[f"{p}_estimate"] < x[f"{p}_ci_high"] for x in rows for p in "mi") and time.monotonic() - begin < 60


def test_many_series_are_drawn_in_time(spark):
    """All 10,000 resamples of 3,000 series of 60 rows, of which a few are held against draws for each row; a number for each row and resample took minutes."""
    r = np.random.default_rng(4)
    data = {s: r.exponential(3, 60) for s in range(3000)}
    df = frame(spark, data).cache()
    df.count()
    begin = time.monotonic()
    got = {x["series_id"]: x for x in resample.poisson_bootstrap(df, "v").collect()}
    assert time.monotonic() - begin < 60 and set(got) == set(data)
    for s in (0, 7):
        found = plain(data[s], 0.5, 20_000, 6)
        for end, q in (("ci_low", 0.025), ("ci_high", 0.975)):
            assert np.quantile(found, q - 0.006) <= got[s][end] <= np.quantile(found, q + 0.006)


def test_percentiles_of_counted_values():
    v, times = np.array([1.0, 2.0, 4.0, 8.0]), np.array([3, 0, 1, 7])
    for shares in ([0.0, 1.0], [0.025, 0.975], [0.3, 0.35]):
        assert np.allclose(resample._percentiles(v, times, shares), np.quantile(np.repeat(v, times), shares))
    assert len(resample._percentiles(v, 0 * times, [0.5])) == 0
