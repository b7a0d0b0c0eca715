"""Kernel density on a grid against the direct sum over all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulseloom.operators import density


def direct(points, weights, bandwidth=0.15):
    w = weights / weights.sum()
    c = np.cov(points[weights > 0].T, aweights=w[weights > 0]) * bandwidth**2
    inverse, factor = np.linalg.inv(c), 1 / (2 * np.pi * np.sqrt(np.linalg.det(c)))
    d = points[:, None, :] - points[None]
    return np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, inverse, d)) @ w * factor


def samples(r):
    a = np.column_stack((r.uniform(0, 360, 400), r.normal(0, 2, 400)))
    b = np.column_stack((r.normal(0, 1, 300), r.normal(0, 1, 300)))
    b[:, 1] = b[:, 0] * 3 + b[:, 1] * 0.2 + 1e6
    c = np.r_[a[:200], np.repeat([[90.0, 1.5]], 300, 0), [[9e4, 700.0]]]
    return {1: a, 2: b, 3: c}


def test_every_row_is_within_the_bound(spark):
    data = samples(np.random.default_rng(3))
    rows = pd.concat(pd.DataFrame({"s": k, "x": p[:, 0], "y": p[:, 1], "n": range(len(p))}) for k, p in data.items())
    got = density.kernel_density(spark.createDataFrame(rows).repartition(5), "x", "y", keys=["s"]).toPandas()
    assert len(got) == len(rows)
    for k, p in data.items():
        found = got[got.s == k].sort_values("n").density.to_numpy()
        want = direct(p, np.abs(p[:, 1]))
        assert np.abs(found - want).max() <= 0.01 * want.max(), k


def test_without_keys_and_with_a_given_weight(spark):
    p = samples(np.random.default_rng(4))[1]
    w = np.random.default_rng(5).integers(0, 3, len(p)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "w": w, "n": range(len(p))}))
    found = density.kernel_density(df, "x", "y", F.col("w")).toPandas().sort_values("n").density.to_numpy()
    want = direct(p, w)
    assert np.abs(found - want).max() <= 0.01 * want.max()


def test_finer_steps_come_nearer(spark):
    p = samples(np.random.default_rng(6))[1]
    df = spark.createDataFrame(pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "n": range(len(p))}))
    want = direct(p, np.abs(p[:, 1]))
    error = [np.abs(density.kernel_density(df, "x", "y", steps=s).toPandas().sort_values("n").density.to_numpy() - want).max() / want.max() for s in (2, 8)]
    assert error[1] < error[0] / 3 and error[1] < 0.002


def test_groups_without_spread_have_none(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 3.0), (2, 1.0, 1.0), (2, 1.0, 2.0), (2, 1.0, 4.0), (3, 1.0, 1.0), (3, 2.0, 2.0), (3, 3.0, 3.0), (4, None, 1.0), (4, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "s long, x double, y double")
    got = density.kernel_density(df, "x", "y", keys=["s"]).collect()
    assert len(got) == len(rows) and all(r["density"] is None for r in got)
    assert density.kernel_density(df.limit(0), "x", "y", keys=["s"]).count() == 0


def test_rows_without_a_place_or_weight_change_nothing(spark):
    p = samples(np.random.default_rng(7))[1][:60]
    rows = [(n, float(a), float(b), 1.0) for n, (a, b) in enumerate(p)]
    odd = [(100, None, 1.0, 1.0), (101, float("nan"), 1.0, 1.0), (102, 1.0, float("nan"), 1.0), (103, 50.0, 0.5, None), (104, 60.0, 0.5, float("nan")), (105, 70.0, 0.5, -3.0)]
    found = [{r["n"]: r["density"] for r in density.kernel_density(spark.createDataFrame(x, "n long, x double, y double, w double"), "x", "y", F.col("w")).collect()} for x in (rows, rows + odd)]
    assert all(abs(found[0][n] - found[1][n]) < 1e-12 for n, *_ in rows)
    assert all(found[1][n] is None for n in (100, 101, 102)) and all(found[1][n] >= 0 for n in (103, 104, 105))


def test_a_row_moves_few_times(spark, monkeypatch):
    """Sparse rows over many tiles: a tile's edge changes nothing, and cells do not multiply by the nodes of the kernel."""
    p = samples(np.random.default_rng(8))
    rows = pd.concat(pd.DataFrame({"s": k, "x": a[:, 0], "y": a[:, 1], "n": range(len(a))}) for k, a in p.items())
    df = spark.createDataFrame(rows)
    found = []
    for tile in (8, 64, density.TILE):
        monkeypatch.setattr(density, "TILE", tile)
        found.append(density.kernel_density(df, "x", "y", keys=["s"]).toPandas().sort_values(["s", "n"]).density.to_numpy())
    assert np.allclose(found[0], found[2], rtol=1e-9, atol=0) and np.allclose(found[1], found[2], rtol=1e-9, atol=0)
    shape = spark.createDataFrame([(1, i, i * 7 % 300, 1.0, 0.0, 0.0, 0.0) for i in range(-100, 100)], "s long, i long, j long, w00 double, w01 double, w10 double, w11 double")
    dealt = []
    monkeypatch.setattr(type(shape), "repartition", lambda self, *a, f=type(shape).repartition: dealt.append(self) or f(self, *a))
    assert density._read_off(shape, ["s"], density.STEPS, 3).count() == 200
    assert len(dealt) == 1 and dealt[0].count() <= 2 * 200
