"""Rank tests, unit-root test and their p-values against direct computations."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import hypothesis, ranks


def slow_pair(x, y):
    """U of x, and the tie sum, by all pairs of rows."""
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    both = list(x) + list(y)
    return u, sum(n**3 - n for n in (both.count(v) for v in set(both)))


def test_exact_tails_count_all_orders():
    for n1, n2 in ((1, 1), (1, 5), (2, 3), (3, 3), (4, 2), (5, 4)):
        found = [0] * (n1 * n2 + 1)
        for chosen in itertools.combinations(range(n1 + n2), n1):
            found[sum(chosen) - n1 * (n1 - 1) // 2] += 1
        total = math.comb(n1 + n2, n1)
        assert np.allclose(ranks.exact_tail(n1, n2), [sum(found[u:]) / total for u in range(n1 * n2 + 1)])


@pytest.mark.parametrize("numbers", [1 << 20, 8])
def test_mann_whitney_of_all_pairs(spark, monkeypatch, numbers):
    monkeypatch.setattr(ranks, "NUMBERS", numbers)
    r = np.random.default_rng(2)
    groups = {f"g{i}": (r.integers(0, 12, n) if i % 2 else r.normal(5, 3, n)).astype(float).tolist() for i, n in enumerate((1, 4, 7, 30, 60, 9, 3))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("g1", None), ("g2", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(x["a"], x["b"]): x for x in hypothesis.mann_whitney(df, "v", "g").collect()}
    assert set(got) == set(itertools.combinations(sorted(groups), 2))
    for (a, b), x in got.items():
        n1, n2 = len(groups[a]), len(groups[b])
        u, ties = slow_pair(groups[a], groups[b])
        assert (x["n1"], x["n2"], x["u"]) == (n1, n2, u)
        if ties == 0 and min(n1, n2) <= 8:
            p = min(1.0, 2 * ranks.exact_tail(n1, n2)[int(max(u, n1 * n2 - u))])
        else:
            n = n1 + n2
            sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
            p = min(1.0, math.erfc(max(abs(u - n1 * n2 / 2) - 0.5, 0) / sigma / math.sqrt(2))) if sigma else 1.0
        assert abs(x["p_value"] - p) < 1e-9 and x["significant"] == (p < 0.05 / len(got))
    assert hypothesis.mann_whitney(df.limit(0), "v", "g").count() == 0


def test_more_groups_than_a_thousand(spark):
    df = spark.range(3300).select((F.col("id") % 1100).alias("g"), ((F.col("id") * 7919) % 3301).cast("double").alias("v"))
    out = hypothesis.mann_whitney(df, "v", "g")
    assert out.count() == 1100 * 1099 // 2
    rows = {g: sorted((g + 1100 * k) * 7919 % 3301 for k in range(3)) for g in (3, 700)}
    x = out.filter("a = 3 AND b = 700").first()
    assert x["u"] == slow_pair(rows[3], rows[700])[0]


def test_two_sample_ks(spark):
    r = np.random.default_rng(4)
    frames, want = [], {}
    for s, (n1, n2) in enumerate(((1, 1), (5, 9), (200, 300), (40, 40), (7, 0))):
        x, y = r.integers(0, 30, n1).astype(float), r.normal(12, 9, n2)
        frames.append(pd.DataFrame({"series_id": s, "v": np.r_[x, y], "f": [True] * n1 + [False] * n2}))
        if n1 and n2:
            want[s] = max(abs((x <= v).mean() - (y <= v).mean()) for v in np.r_[x, y])
    df = spark.createDataFrame(pd.concat(frames), "series_id long, v double, f boolean").repartition(5)
    got = {x["series_id"]: x for x in hypothesis.two_sample_ks(df, "v", F.col("f")).collect()}
    assert set(got) == set(want)
    for s, d in want.items():
        x = got[s]
        assert abs(x["distance"] - d) < 1e-12
        root = math.sqrt(x["n1"] * x["n2"] / (x["n1"] + x["n2"]))
        lam = (root + 0.12 + 0.11 / root) * d
        p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 200))
        assert abs(x["p_value"] - min(1, max(0, p))) < 1e-9


def slow_adf(x):
    """Regressions on the columns themselves, by least squares."""
    n, dx = len(x), np.diff(x)
    best = None

    def fit(p):
        y = dx[p:]
        cols = np.column_stack([x[p : n - 1], np.ones(len(y)), *(dx[p - j : len(dx) - j] for j in range(1, p + 1))])
        beta = np.linalg.lstsq(cols, y, rcond=None)[0]
        return y, cols, beta, float(((y - cols @ beta) ** 2).sum())

    for p in range(min(math.ceil(12 * (n / 100) ** 0.25), (n - 1) // 3) + 1):
        y, cols, _, sse = fit(p)
        if len(y) < p + 2:
            continue
        aic = len(y) * math.log(sse / len(y) + 1e-30) + 2 * cols.shape[1]
        if best is None or aic < best[0]:
            best = aic, p
    y, cols, beta, sse = fit(best[1])
    return best[1], beta[0] / math.sqrt(sse / (len(y) - cols.shape[1]) * np.linalg.inv(cols.T @ cols)[0, 0])


def test_adf_from_sums_is_least_squares_on_columns(spark):
    r = np.random.default_rng(6)
    walks = {1: np.cumsum(r.normal(size=300)), 2: r.normal(size=250) + 1e4, 3: r.exponential(2, 66), 4: np.cumsum(r.normal(size=20)), 5: r.normal(size=19), 6: np.full(40, 3.0), 7: r.normal(size=31)}
    for i in range(1, 300):
        walks[1][i] = 0.6 * walks[1][i - 1] + r.normal()
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": s, "k": range(len(x)), "v": x}) for s, x in walks.items()]), "series_id long, k long, v double").repartition(3)
    got = {x["series_id"]: x for x in hypothesis.adf(df, "v").collect()}
    assert set(got) == set(walks)
    for s in (1, 2, 3, 4, 7):
        lags, t = slow_adf(walks[s])
        assert got[s]["lags"] == lags and abs(got[s]["statistic"] - t) < 1e-6 * max(1, abs(t)), s
    assert got[5]["p_value"] == 1.0 and got[5]["lags"] == 0 and got[6]["statistic"] == 0.0
    assert hypothesis.adf(df.limit(0), "v").count() == 0
