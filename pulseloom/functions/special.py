"""Distribution functions and fits that the tests need; only the standard library and numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series below a + 1 and by continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, k: int) -> float:
    return gamma_q(k / 2, x / 2)


def chi2_ppf(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while 1 - chi2_sf(high, k) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi2_sf(middle, k) < p else (low, middle)
    return (low + high) / 2


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic p-value of a Kolmogorov distance, with Stephens' correction for small n."""
    root = math.sqrt(n)
    t = (root + 0.12 + 0.11 / root) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))))


def weibull_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale by maximum likelihood: Newton steps on the profile equation, bisected where they leave the bracket."""
    x = np.asarray(x, float)
    if len(x) == 0 or x.min() <= 0 or x.max() == x.min():
        return math.nan, math.nan
    logs = np.log(x / x.max())
    mean = logs.mean()

    def slope(b: float) -> float:
        w = np.exp(b * logs)
        return float((w * logs).sum() / w.sum() - 1 / b - mean)

    low, high = 1e-6, 1.0
    while slope(high) < 0 and high < 1e9:
        low, high = high, 2 * high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    beta = (low + high) / 2
    return beta, float(x.max() * np.exp(beta * logs).mean() ** (1 / beta))


def weibull_fits(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and scales of many samples, which lie behind one another in values: as ``weibull_fit``, NaN where there is none.

    Samples go through side by side, by Newton steps; one that leaves its bracket halves that.
    """
    n = len(sizes)
    beta, eta = np.full(n, np.nan), np.full(n, np.nan)
    used = np.arange(int(sizes.max(initial=0))) < sizes[:, None]
    x = np.ones(used.shape)
    x[used] = values
    top, least = np.where(used, x, -np.inf).max(axis=1, initial=-np.inf), np.where(used, x, np.inf).min(axis=1, initial=np.inf)
    fit = np.flatnonzero((least > 0) & (top > least) & np.isfinite(top))
    if not len(fit):
        return beta, eta
    used, count = used[fit], sizes[fit]
    logs = np.where(used, np.log(x[fit] / top[fit, None]), 0.0)
    mean = logs.sum(axis=1) / count
    spread = np.sqrt((np.where(used, logs - mean[:, None], 0.0) ** 2).sum(axis=1) / count)
    low, high = np.full(len(fit), 1e-6), np.full(len(fit), 2.0**30)
    b = np.clip(math.pi / math.sqrt(6) / np.maximum(spread, 1e-300), low, high)
    at = np.arange(len(fit))
    for _ in range(200):
        y, c = logs[at], b[at]
        w = np.where(used[at], np.exp(c[:, None] * y), 0.0)
        total = w.sum(axis=1)
        first = (w * y).sum(axis=1) / total
        slope = first - 1 / c - mean[at]
        low[at], high[at] = np.where(slope < 0, c, low[at]), np.where(slope < 0, high[at], c)
        step = c - slope / ((w * y * y).sum(axis=1) / total - first * first + 1 / (c * c))
        inside = (step > low[at]) & (step < high[at])
        b[at] = np.where(inside, step, np.where(slope == 0, c, np.sqrt(low[at] * high[at])))
        at = at[np.abs(b[at] - c) > 1e-9 * c]
        if not len(at):
            break
    beta[fit] = b
    eta[fit] = top[fit] * (np.where(used, np.exp(b[:, None] * logs), 0.0).sum(axis=1) / count) ** (1 / b)
    return beta, eta


@F.arrow_udf(T.StructType([T.StructField("beta", T.DoubleType()), T.StructField("eta", T.DoubleType())]))
def weibull_fit_udf(frames: pa.Array) -> pa.Array:
    sizes = np.diff(frames.offsets.to_numpy())
    found = weibull_fits(frames.flatten().to_numpy(zero_copy_only=False), sizes * np.asarray(frames.is_valid()))
    return pa.StructArray.from_arrays([pa.array(c, pa.float64(), from_pandas=True) for c in found], ["beta", "eta"])
