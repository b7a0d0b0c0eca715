"""Signal kernels on one array each: transforms, filters, wavelets, peaks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def envelope(x: np.ndarray) -> np.ndarray:
    """Modulus of the analytic signal."""
    n = len(x)
    if n == 0:
        return np.zeros(0)
    weights = np.zeros(n)
    weights[0] = 1
    weights[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weights[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * weights))


def periodogram(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, float) - np.mean(x)
    return np.fft.rfftfreq(len(x), 1 / fs), np.abs(np.fft.rfft(x)) ** 2 / max(len(x), 1)


@lru_cache(maxsize=64)
def butter_bandpass(low: float, high: float, order: int) -> tuple[tuple, tuple]:
    """Coefficients (b, a) of a digital Butterworth band-pass; cut-offs are shares of the Nyquist frequency."""
    warp = 4.0
    f1, f2 = (warp * math.tan(math.pi * w / 2) for w in (low, high))
    width, centre = f2 - f1, math.sqrt(f1 * f2)
    base = np.array([-np.exp(1j * math.pi * (2 * k - order + 1) / (2 * order)) for k in range(order)]) * width / 2
    root = np.sqrt(base**2 - centre**2)
    poles = np.concatenate((base + root, base - root))
    gain = width**order * np.real(warp**order / np.prod(warp - poles))
    digital = (warp + poles) / (warp - poles)
    zeros = np.concatenate((np.ones(order), -np.ones(order)))
    return tuple(gain * np.real(np.poly(zeros))), tuple(np.real(np.poly(digital)))


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed."""
    y = np.empty(len(x))
    z = state.copy()
    for i, v in enumerate(x):
        out = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * out
        z[-1] = b[-1] * v - a[-1] * out
        y[i] = out
    return y


def zero_phase(b, a, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension and steady-state start."""
    b, a, x = np.asarray(b, float), np.asarray(a, float), np.asarray(x, float)
    taps = max(len(a), len(b))
    pad = 3 * taps
    if len(x) <= pad:
        raise ValueError(f"needs more than {pad} samples")
    companion = np.zeros((taps - 1, taps - 1))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(taps - 2)
    start = np.linalg.solve(np.eye(taps - 1) - companion, b[1:] - a[1:] * b[0])
    long = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    y = _filter(b, a, long, start * long[0])[::-1]
    return _filter(b, a, y, start * y[0])[::-1][pad:-pad]


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 5) -> np.ndarray:
    """Zero-phase Butterworth band-pass; cut-offs are kept within 0.001 to 0.999 of the Nyquist frequency."""
    clamp = lambda f: min(0.999, max(0.001, f / (fs / 2)))
    return zero_phase(*butter_bandpass(clamp(low), clamp(high), order), x)


@lru_cache(maxsize=16)
def daubechies(moments: int, least_asymmetric: bool = False) -> np.ndarray:
    """Low-pass filter with that many vanishing moments, by spectral factorisation of Daubechies' polynomial.

    The extremal-phase filter takes all roots inside the circle; the least
    asymmetric one the choice of roots whose phase is nearest to linear.
    """
    p = [math.comb(moments - 1 + k, k) for k in range(moments)]
    groups = []
    for y in np.roots(p[::-1]):
        z = np.roots([1, 4 * y - 2, 1])
        inside = z[np.abs(z) < 1][0]
        if abs(inside.imag) < 1e-10:
            groups.append((inside.real,))
        elif inside.imag > 0:
            groups.append((inside, np.conj(inside)))

    def build(choice: int) -> np.ndarray:
        roots = [-1.0] * moments
        for i, g in enumerate(groups):
            roots += [1 / z for z in g] if choice >> i & 1 else list(g)
        h = np.real(np.poly(roots))
        return h / h.sum() * math.sqrt(2)

    if not least_asymmetric:
        return build(0)

    def bend(h: np.ndarray) -> float:
        w = np.linspace(0.01, math.pi * 0.9, 200)
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(h)))) @ h))
        return float(np.abs(phase - np.polyval(np.polyfit(w, phase, 1), w)).max())

    return min((build(c) for c in range(1 << len(groups))), key=bend)


#: Coiflet with six vanishing moments: fixed values from Daubechies' published table.
COIF3 = np.array([
    -3.459977283621256e-05, -7.098330313814114e-05, 0.0004662169601128863, 0.0011175187708906016, -0.0025745176887502236, -0.00900797613666158,
    0.015880544863615904, 0.03455502757306163, -0.08230192710688598, -0.07179982161931202, 0.42848347637761874, 0.7937772226256206,
    0.4051769024096169, -0.06112339000267287, -0.0657719112818555, 0.023452696141836267, 0.007782596427325418, -0.003793512864491014,
])


def scaling_filter(wavelet: str) -> np.ndarray:
    """Analysis low-pass filter of db4, sym8, coif3 or any dbN, symN."""
    if wavelet == "coif3":
        return COIF3
    kind, n = wavelet[:-len(wavelet.lstrip("dbsym"))], wavelet.lstrip("dbsym")
    if kind not in ("db", "sym") or not n.isdigit():
        raise ValueError(f"unknown wavelet {wavelet!r}")
    h = daubechies(int(n), kind == "sym")
    return h[::-1] if np.argmax(np.abs(h)) < len(h) / 2 else h


def _split(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    taps = len(low)
    high = low[::-1] * (-1.0) ** (np.arange(taps) + 1)
    n = len(x)
    # Half-sample symmetric extension, as often as a short signal needs it.
    index = np.arange(-(taps - 1), n + taps - 1) % (2 * n)
    long = x[np.where(index < n, index, 2 * n - 1 - index)]
    return np.convolve(long, low, "valid")[1::2], np.convolve(long, high, "valid")[1::2]


def _merge(approximation: np.ndarray, detail: np.ndarray, low: np.ndarray) -> np.ndarray:
    taps = len(low)
    high = low[::-1] * (-1.0) ** (np.arange(taps) + 1)

    def up(c, f):
        wide = np.zeros(2 * len(c))
        wide[::2] = c
        return np.convolve(wide, f[::-1])

    y = up(approximation, low) + up(detail, high)
    return y[taps - 2 : taps - 2 + 2 * len(detail) - taps + 2]


def max_level(n: int, taps: int) -> int:
    return max(0, int(math.floor(math.log2(n / (taps - 1))))) if n >= taps - 1 else 0


def wavedec(x: np.ndarray, wavelet: str, level: int) -> list[np.ndarray]:
    """[approximation, coarsest detail, ..., finest detail]."""
    low, details = scaling_filter(wavelet), []
    a = np.asarray(x, float)
    for _ in range(level):
        a, d = _split(a, low)
        details.append(d)
    return [a, *details[::-1]]


def waverec(parts: list[np.ndarray], wavelet: str) -> np.ndarray:
    low, a = scaling_filter(wavelet), parts[0]
    for d in parts[1:]:
        a = _merge(a[: len(d)], d, low)
    return a


def sure_threshold(c: np.ndarray) -> float:
    """The magnitude among those of c that minimises Stein's unbiased risk."""
    squares = np.sort(np.asarray(c) ** 2)
    n = len(squares)
    if n == 0:
        return 0.0
    k = np.arange(1, n + 1)
    risk = (n - 2 * k + np.cumsum(squares) + (n - k) * squares) / n
    return float(math.sqrt(squares[int(np.argmin(risk))]))


def threshold_value(detail: np.ndarray, n: int, rule: str, floor: float = 1e-15) -> float:
    sigma = float(np.median(np.abs(detail))) / 0.6745 + floor
    if rule in ("universal", "sqtwolog"):
        return sigma * math.sqrt(2 * math.log(n))
    if rule == "minimax":
        return 0.0 if n <= 32 else sigma * (0.3936 + 0.1829 * math.log2(n))
    if rule == "sure":
        return sigma * sure_threshold(detail / sigma)
    raise ValueError(f"unknown rule {rule!r}")


def denoise(x: np.ndarray, wavelet: str = "db4", mode: str = "hard", rule: str = "minimax", level: int | None = None) -> np.ndarray:
    """Threshold the wavelet details at the noise of the finest ones; same length as x."""
    x = np.asarray(x, float)
    n = len(x)
    level = min(max_level(n, len(scaling_filter(wavelet))), 6) if level is None else level
    if level < 1:
        return x.copy()
    parts = wavedec(x, wavelet, level)
    limit = threshold_value(parts[-1], n, rule)
    for i in range(1, len(parts)):
        c = parts[i]
        if mode == "hard":
            parts[i] = np.where(np.abs(c) >= limit, c, 0.0)
        elif mode == "soft":
            parts[i] = np.sign(c) * np.maximum(np.abs(c) - limit, 0.0)
        else:
            raise ValueError(f"unknown mode {mode!r}")
    y = waverec(parts, wavelet)[:n]
    return y if len(y) == n else np.pad(y, (0, n - len(y)), mode="edge")


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; a plateau counts at its middle, rounded down; ends never count."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    end = np.append(begin[1:], len(x)) - 1
    v = x[begin]
    inner = np.arange(1, len(v) - 1)
    top = inner[(v[inner] > v[inner - 1]) & (v[inner] > v[inner + 1])]
    return (begin[top] + end[top]) // 2


def keep_distant(peaks: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Peaks that no higher kept peak is nearer to than ``distance`` samples."""
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep &= ~near
    return peaks[keep]


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak above the higher of the lowest points before a strictly higher sample on either side."""
    out = np.empty(len(peaks))
    for j, p in enumerate(peaks):
        above = np.flatnonzero(x > x[p])
        left = above[above < p]
        right = above[above > p]
        a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(x))
        out[j] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    return out


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1:
        peaks = keep_distant(peaks, x[peaks], distance)
    if prominence is not None:
        peaks = peaks[prominences(x, peaks) >= prominence]
    return peaks


def detect(x: np.ndarray, fs: float, k: float = 3.0, separation_s: float = 0.0, method: str = "threshold") -> np.ndarray:
    """Pulse positions on the magnitude of x, by threshold or by prominence."""
    m = np.abs(np.asarray(x, float))
    distance = max(1, int(separation_s * fs))
    if method == "threshold":
        return find_peaks(m, height=m.mean() + k * m.std(), distance=distance)
    if method == "prominence":
        return find_peaks(m, prominence=0.5 * k * m.std(), distance=distance)
    raise ValueError(f"unknown method {method!r}")


def cfar(x: np.ndarray, window: int = 64, guard: int = 8, pfa: float = 1e-4, min_distance: int = 0) -> np.ndarray:
    """The windowed constant-false-alarm-rate detector on one array, with first arrivals."""
    n, total = len(x), np.concatenate(([0.0], np.cumsum(np.asarray(x, float) ** 2)))
    k = np.arange(window + guard, n - window - guard)
    if not len(k):
        return k
    noise = (total[k - guard] - total[k - guard - window] + total[k + guard + window + 1] - total[k + guard + 1]) / (2 * window)
    hits = k[(total[k + 1] - total[k]) > window * (pfa ** (-1.0 / window) - 1) * noise]
    return hits[np.concatenate(([True], np.diff(hits) > min_distance))] if len(hits) else hits


def intervals(x: np.ndarray, fs: float, k: float = 3.0, separation_s: float = 0.0, method: str = "threshold") -> np.ndarray:
    """Intervals in seconds between the pulses that a method (threshold, prominence or cfar) finds."""
    pulses = cfar(x) if method == "cfar" else detect(x, fs, k, separation_s, method)
    return np.diff(pulses) / fs


def morphology(x: np.ndarray, peaks: np.ndarray, fs: float, back_ns: float = 10.0, forward_ns: float = 100.0) -> list[tuple]:
    """(position, peak, rise, fall, width at half height; times in ns) of each pulse's window."""
    m, out = np.abs(np.asarray(x, float)), []
    back, forward = int(back_ns * 1e-9 * fs), int(forward_ns * 1e-9 * fs)
    first = lambda mask, otherwise: int(np.argmax(mask)) if mask.any() else otherwise
    last = lambda mask: int(np.flatnonzero(mask)[-1]) if mask.any() else 0
    for p in peaks:
        w = m[max(0, p - back) : min(len(m), p + forward)]
        if len(w) < 5 or w.max() <= 0:
            continue
        top = int(np.argmax(w))
        v, before, after = w[top], w[: top + 1], w[top:]
        rise = first(before >= 0.9 * v, top) - last(before <= 0.1 * v)
        fall = first(after <= 0.1 * v, len(after) - 1) - first(after <= 0.9 * v, 0)
        half = first(after <= 0.5 * v, len(w) - 1 - top) + top - last(before <= 0.5 * v)
        out.append((int(p), float(v), *(max(0, s) / fs * 1e9 for s in (rise, fall, half))))
    return out


def synthesize(n: int = 4096, fs: float = 1e9, pulses: int = 12, snr_db: float = 30.0, seed: int = 0, band=(300e6, 3e9, 4), interference=((0.05, 900e6), (0.02, 1.8e9)), corona_rate: float = 200.0) -> tuple[np.ndarray, np.ndarray]:
    """(clean, noisy): double-exponential pulses through a lossy dielectric and a band-pass antenna, with noise and interference."""
    r = np.random.default_rng(seed)
    t = np.arange(n) / fs
    current = np.zeros(n)
    for at in np.sort(r.integers(0, max(1, n - 100), pulses)):
        rise, decay, size = r.uniform(0.5e-9, 2e-9), r.uniform(5e-9, 20e-9), r.uniform(0.5, 2.0)
        tail = t[: n - at]
        current[at:] += size * (np.exp(-tail / decay) - np.exp(-tail / rise))
    f = np.fft.rfftfreq(n, 1 / fs)
    permittivity, loss, metres = 2.2, 0.005, 0.3
    dielectric = np.exp(-np.pi * f * math.sqrt(permittivity) * loss * metres / 299_792_458.0)
    low, high, order = band
    safe = np.maximum(f, 1.0)
    antenna = 1 / np.sqrt(1 + (low / safe) ** (2 * order)) / np.sqrt(1 + (safe / high) ** (2 * order))
    antenna[0] = 0
    clean = np.fft.irfft(np.fft.rfft(current) * dielectric * antenna, n=n)
    noise = r.normal(0, math.sqrt((np.mean(clean**2) + 1e-30) / 10 ** (snr_db / 10)), n)
    tones = sum(a * clean.max() * np.sin(2 * np.pi * g * t) for a, g in interference)
    corona = np.zeros(n)
    for _ in range(r.poisson(corona_rate * n / fs)):
        at, g, tau, a = r.integers(0, max(1, n - 100)), r.uniform(20e6, 80e6), r.uniform(5e-9, 20e-9), r.uniform(0.01, 0.05) * clean.max()
        tail = t[: min(100, n - at)]
        corona[at : at + len(tail)] += a * np.exp(-tail / tau) * np.sin(2 * np.pi * g * tail)
    return clean, clean + noise + tones + corona
