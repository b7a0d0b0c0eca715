"""Recurrences over one ordered vector."""

from __future__ import annotations

import numpy as np


def kalman(z: np.ndarray, q: float, r: float, p0: float, gap: float = 10.0, x0: float | None = None) -> dict[str, np.ndarray]:
    """Random-walk Kalman filter. A value above ``gap`` first sets the state to itself and the variance to p0."""
    n = len(z)
    state, innovation, variance = np.empty(n), np.zeros(n), np.empty(n)
    x, p = (x0 if x0 is not None else (z[0] if n else 0.0)), p0
    for i in range(n):
        if z[i] > gap:
            x, p = z[i], p0
        ahead = p + q
        variance[i] = ahead + r
        gain = ahead / variance[i]
        innovation[i] = z[i] - x
        x, p = x + gain * innovation[i], (1 - gain) * ahead
        state[i] = x
    return {"kalman_filtered": state, "kalman_innovation": innovation, "kalman_variance": variance, "kalman_z": innovation / np.sqrt(variance)}


def linear(z: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """s = alpha z + (1 - alpha) s, begun at the first value."""
    out = np.empty(len(z))
    s = z[0] if len(z) else 0.0
    for i in range(len(z)):
        s = alpha[i] * z[i] + (1 - alpha[i]) * s
        out[i] = s
    return out


def _histories(x: np.ndarray, order: int):
    """From row ``order`` on, the values seen since then, the latest first; what is not there yet is 0. x: [row] or [row, series]."""
    seen = np.zeros((order, *x.shape[1:]))
    for i in range(order, len(x)):
        seen = np.concatenate((x[i - 1 : i], seen[:-1]))
        yield i, seen


def lms_predict(x: np.ndarray, order: int = 8, mu: float = 0.01, bound: float = 10.0) -> dict[str, np.ndarray]:
    """One-step prediction with bounded weights; the first ``order`` rows pass through. x: [row] or [row, series]."""
    guess, error, w = x.astype(float).copy(), np.zeros(x.shape), np.zeros((order, *x.shape[1:]))
    for i, seen in _histories(x, order):
        guess[i] = (w * seen).sum(0)
        error[i] = x[i] - guess[i]
        w = np.clip(w + 2 * mu * error[i] * seen, -bound, bound)
    return {"lms_prediction": guess, "lms_error": error}


def rls_predict(x: np.ndarray, order: int = 8, forgetting: float = 0.99, p0: float = 1000.0) -> dict[str, np.ndarray]:
    """One-step prediction by recursive least squares; the first ``order`` rows pass through. x: [row] or [row, series]."""
    guess, error, w = x.astype(float).copy(), np.zeros(x.shape), np.zeros((order, *x.shape[1:]))
    p = np.zeros((order, order, *x.shape[1:]))
    p[np.arange(order), np.arange(order)] = p0
    for i, seen in _histories(x, order):
        guess[i] = (w * seen).sum(0)
        error[i] = x[i] - guess[i]
        along = (p * seen).sum(1)
        k = along / (forgetting + (seen * along).sum(0))
        w = w + k * error[i]
        p = (p - k[:, None] * (seen[:, None] * p).sum(0)) / forgetting
    return {"rls_prediction": guess, "rls_error": error}


def lms_cancel(x: np.ndarray, reference: np.ndarray | None = None, mu: float = 0.01, order: int = 32) -> np.ndarray:
    """What of x its reference (x delayed by ``order`` when none is given) doesn't explain; the first ``order`` values are 0."""
    ref = np.roll(x, order) if reference is None else reference
    out, w = np.zeros(len(x)), np.zeros(order)
    for i in range(order, len(x)):
        past = ref[i - order : i][::-1]
        out[i] = x[i] - w @ past
        w = w + 2 * mu * out[i] * past
    return out


def cusum(z: np.ndarray, threshold: float = 5.0, drift: float = 0.5, burnin: int = 200, mu_0: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same two-sided CUSUM as the window form, for kernels that already run inside a task."""
    if not len(z):
        return np.zeros(0), np.zeros(0), np.zeros(0, bool)
    mu = z[:burnin].mean() if mu_0 is None else mu_0
    up, down = np.cumsum(np.r_[0.0, z[1:] - mu - drift]), np.cumsum(np.r_[0.0, mu - z[1:] - drift])
    plus, minus = up - np.minimum.accumulate(up), down - np.minimum.accumulate(down)
    return plus, minus, (plus > threshold) | (minus > threshold)
