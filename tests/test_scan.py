"""Recurrences by blocks against loops over whole series."""

import numpy as np
import pandas as pd
import pytest

from pulseloom.functions import recurrences
from pulseloom.operators import scan, track


def intervals(spark, seed=1, sizes=(1, 2, 63, 64, 65, 200, 700)):
    r = np.random.default_rng(seed)
    frames = [pd.DataFrame({"series_id": i, "k": range(n), "delta_t_s": r.exponential(4.0, n) + (r.random(n) < 0.05) * 20}) for i, n in enumerate(sizes)]
    return pd.concat(frames), spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=seed), "series_id long, k long, delta_t_s double").repartition(5)


@pytest.mark.parametrize("chunk", [1 << 18, 50, 1])
def test_kalman_and_ewma_by_chunks(spark, monkeypatch, chunk):
    """Whole series in a chunk, series cut into many, and a chunk for each row."""
    monkeypatch.setattr(scan, "CHUNK", chunk)
    pdf, df = intervals(spark, sizes=(1, 2, 63, 64, 65, 200, 700) if chunk > 1 else (1, 2, 9))
    got = track.kalman(df, 0.5, 2.0, 1.0, 10.0).toPandas().sort_values(["series_id", "k"])
    mean = track.ewma(df, 0.3).toPandas().sort_values(["series_id", "k"])
    assert len(got) == len(mean) == len(pdf)
    for i, part in pdf.groupby("series_id"):
        z = part["delta_t_s"].to_numpy()
        for name, values in recurrences.kalman(z, 0.5, 2.0, 1.0, 10.0).items():
            assert np.allclose(got.loc[got["series_id"] == i, name], values, rtol=1e-9, atol=1e-12), name
        assert np.allclose(mean.loc[mean["series_id"] == i, "ewma"], recurrences.linear(z, np.full(len(z), 0.3)), rtol=1e-12)


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_unified_in_one_pass(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    pdf, df = intervals(spark, 3)
    got = track.unified(df, 0.5, 2.0, 1.0, 10.0).toPandas().sort_values(["series_id", "k"])
    for i, part in pdf.groupby("series_id"):
        z, mine = part["delta_t_s"].to_numpy(), got[got["series_id"] == i]
        assert np.allclose(mine["kalman_z"], recurrences.kalman(z, 0.5, 2.0, 1.0, 10.0)["kalman_z"], rtol=1e-9, atol=1e-12)
        assert np.allclose(mine["ewma"], recurrences.linear(z, mine["alpha"].to_numpy()), rtol=1e-12)


def test_a_start_that_is_given(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 30)
    pdf, df = intervals(spark, 4, (100,))
    got = track.kalman(df, 0.5, 2.0, 1.0, 1e9, x0=7.0).orderBy("k").toPandas()
    assert np.allclose(got["kalman_filtered"], recurrences.kalman(pdf["delta_t_s"].to_numpy(), 0.5, 2.0, 1.0, 1e9, 7.0)["kalman_filtered"])


@pytest.mark.parametrize("chunk", [1 << 18, 1])
def test_null_series_and_no_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0), (3, 0, 5.0)], "series_id long, k long, delta_t_s double")
    assert [r["ewma"] for r in track.ewma(df, 0.5).orderBy("series_id", "k").collect()] == [1.0, 1.5, 5.0]
    assert track.kalman(df.limit(0)).count() == 0


def test_lanes_compose():
    """A lane for each few rows gives what one lane for all gives."""
    r = np.random.default_rng(7)
    sizes = np.array([5, 1, 17, 30])
    z, alpha = r.normal(size=53), r.uniform(0.05, 0.8, 53)
    fold = scan.Ewma("z", "alpha")
    data = {"z": z, "alpha": alpha}
    runs = [fold.run(g, data, fold.begin(g, data))[0] for g in (scan.Grid(sizes, 4), scan.Grid(sizes, 64))]
    assert np.allclose(*runs)
    assert np.allclose(fold.map(0, scan.Grid(sizes, 4), data, None), fold.map(0, scan.Grid(sizes, 64), data, None))


def test_predictors_side_by_side(spark):
    pdf, df = intervals(spark, 5, (1, 7, 8, 9, 40, 90))
    df = df.withColumn("delta_t_s", df["delta_t_s"] / 10)
    got = track.rls(track.lms(df)).toPandas().sort_values(["series_id", "k"])
    for i, part in pdf.groupby("series_id"):
        z = part["delta_t_s"].to_numpy() / 10
        for name, values in (recurrences.lms_predict(z) | recurrences.rls_predict(z)).items():
            assert np.allclose(got.loc[got["series_id"] == i, name], values, rtol=1e-6, atol=1e-8), name
