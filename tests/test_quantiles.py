"""Exact quantiles by refinement against the values in order."""

import numpy as np
import pandas as pd
import pytest

from pulseloom.operators import campaign, quantiles

SHARES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q1": 1.0}


def groups(r):
    return {
        "uniform": r.uniform(0, 1, 4000), "heavy": 10.0 ** r.uniform(-300, 300, 3000), "ties": r.integers(0, 3, 2500).astype(float),
        "one": np.full(1500, 7.0), "two": np.r_[np.zeros(900), np.ones(901)], "few": r.normal(0, 1, 9), "single": np.array([3.0]), None: r.normal(5, 1, 1200),
    }


@pytest.mark.parametrize("rows,accuracy,targets", [(100_000, 2000, 100_000), (50, 20, 100_000), (200, 50, 0)])
def test_quantiles_of_groups(spark, monkeypatch, rows, accuracy, targets):
    monkeypatch.setattr(quantiles, "ROWS", rows)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "TARGETS", targets)
    data = groups(np.random.default_rng(8))
    table = [(g, float(v)) for g, vs in data.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(table, "grp string, v double").repartition(6)
    got = {x["grp"]: x for x in quantiles.group_quantiles(df, "grp", "v", SHARES).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        for name, share in SHARES.items():
            assert np.isclose(got[g][name], np.quantile(vs, share), rtol=1e-9, atol=0 if g == "heavy" else 1e-12), (g, name)


def test_no_rows(spark):
    df = spark.createDataFrame([], "grp string, v double")
    assert quantiles.group_quantiles(df, "grp", "v", SHARES).count() == 0


def test_summary_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ROWS", 40)
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    r = np.random.default_rng(9)
    pdf = pd.DataFrame({"channel": r.choice(["a", "b"], 700, p=[0.9, 0.1]), "valid_dt": r.exponential(3, 700), "is_outlier": False, "rolling_rate_hz": 1.0})
    pdf.loc[::9, "valid_dt"], pdf.loc[::9, "is_outlier"] = np.nan, True
    events = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = {x["channel"]: x for x in campaign.group_summary(events, "channel").collect()}
    for c, part in pdf.groupby("channel"):
        v = part["valid_dt"].dropna()
        q = np.quantile(v, [0.25, 0.5, 0.75, 0.9])
        assert np.allclose((got[c]["median_dt"], got[c]["iqr_dt"], got[c]["p90_dt"]), (q[1], q[2] - q[0], q[3]))
        assert (got[c]["n_events"], got[c]["n_outliers"]) == (len(part), int(part["is_outlier"].sum()))
