"""Seeded parameter studies: one row for each cell and repeat, spread over tasks, then aggregated."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions import dsp, recurrences

# The grid of denoising parameters.
WAVELETS, MODES, RULES = ("db4", "sym8", "coif3"), ("soft", "hard"), ("universal", "minimax", "sqtwolog")


def _cells(spark: SparkSession, lists: dict[str, list], repeats: int) -> DataFrame:
    """All combinations of the lists and repeats 0.., dealt over the tasks."""
    out = spark.range(repeats).withColumnRenamed("id", "run")
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.repartition(min(64, max(2, repeats)), "run", *lists)


def synthetic_signals(spark: SparkSession, seeds: int, n: int = 4096, fs: float = 1e9, pulses: int = 12, snr_db: float = 30.0) -> DataFrame:
    """Clean and noisy segments by seed: series_id, clean, samples."""

    def run(batches):
        for pdf in batches:
            made = [dsp.synthesize(n, fs, pulses, snr_db, int(s)) for s in pdf["id"]]
            yield pd.DataFrame({"series_id": pdf["id"], "clean": [m[0] for m in made], "samples": [m[1] for m in made]})

    return spark.range(seeds).mapInPandas(run, "series_id long, clean array<double>, samples array<double>")


def denoising_grid(spark: SparkSession, repeats: int = 100, n: int = 4096, fs: float = 1e9, snr: tuple[float, float] = (5.0, 25.0), seed: int = 42, wavelets=WAVELETS, modes=MODES, rules=RULES, reference=None) -> DataFrame:
    """Mean and variance of the denoising error of each cell of the grid.

    White noise of a random level is added to one clean signal, the given one or
    a synthetic one; every cell meets the same noise.
    """
    clean = np.asarray(reference, float) if reference is not None else dsp.synthesize(n, fs, snr_db=40.0, seed=seed)[0]
    power = float(np.mean(clean**2)) + 1e-30

    def run(batches):
        for pdf in batches:
            errors = []
            for r, w, m, rule in zip(pdf["run"], pdf["wavelet"], pdf["mode"], pdf["rule"]):
                g = np.random.default_rng([seed, int(r)])
                noisy = clean + g.normal(0.0, np.sqrt(power / 10 ** (g.uniform(*snr) / 10)), len(clean))
                errors.append(float(np.sqrt(np.mean((dsp.denoise(noisy, w, m, rule) - clean) ** 2))))
            yield pdf.assign(rmse=errors)

    cells = _cells(spark, {"wavelet": list(wavelets), "mode": list(modes), "rule": list(rules)}, repeats)
    out = cells.mapInPandas(run, "run long, wavelet string, mode string, rule string, rmse double")
    return out.groupBy("wavelet", "mode", "rule").agg(F.avg("rmse").alias("mean_rmse"), F.var_pop("rmse").alias("var_rmse"), F.count("*").alias("repeats"))


def best_cell(grid: DataFrame, max_variance: float = 1e-3) -> DataFrame:
    """The cell of least mean error among those of small variance, or among all if there are none."""
    ok = F.col("var_rmse") < max_variance
    return grid.withColumn("feasible", ok).orderBy(F.desc("feasible"), "mean_rmse", "wavelet", "mode", "rule").limit(1)


def _rates(tp: int, fp: int, pos: int, neg: int) -> tuple[float, float, float, float]:
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / pos if pos else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0, fp / neg if neg else 0.0


def _shifted(clean: np.ndarray, noisy: np.ndarray, fs: float, threshold: float, drift: float) -> tuple:
    """Pulses, precision, recall, F1, false-positive rate, latency and denoising error of one signal, whose intervals come a second time at half their length."""
    cleaned = dsp.denoise(noisy, "db4", "soft", "universal")
    error = float(np.sqrt(np.mean((cleaned - clean) ** 2)))
    gaps = dsp.intervals(cleaned, fs, 3.0, 0.0, "prominence")
    cut = len(gaps)
    if cut < 3:
        return cut + 1, 0.0, 0.0, 0.0, 1.0, float(len(clean)), error
    alarms = np.flatnonzero(recurrences.cusum(np.concatenate((gaps, gaps * 0.5)), threshold, drift)[2])
    after = alarms[alarms >= cut]
    latency = float(after[0] - cut) if len(after) else 2.0 * cut
    return cut + 1, *_rates(len(after), len(alarms) - len(after), cut, cut), latency, error


def snr_study(spark: SparkSession, levels=(5.0, 10.0, 15.0, 20.0, 25.0, 30.0), repeats: int = 30, n: int = 4096, fs: float = 1e9, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """Means and deviations over signal-to-noise levels of what CUSUM finds of a change of the intervals, and of the denoising error.

    Every level meets the same seeds. A signal with fewer than three intervals
    counts as an F1 of 0, a false-positive rate of 1 and a latency of n.
    """
    names = ["n_pulses", "precision", "recall", "f1_score", "fpr", "latency", "rmse"]

    def run(batches):
        for pdf in batches:
            rows = [(snr, *_shifted(*dsp.synthesize(n, fs, snr_db=snr, seed=int(r)), fs, threshold, drift)) for r, snr in zip(pdf["run"], pdf["snr_db"])]
            yield pd.DataFrame(rows, columns=["snr_db", *names]).astype(float)

    out = _cells(spark, {"snr_db": [float(x) for x in levels]}, repeats).mapInPandas(run, "snr_db double, " + ", ".join(f"{c} double" for c in names))
    stats = [s for c in names for s in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return out.groupBy("snr_db").agg(F.count("*").alias("runs"), *stats)


def convergence_study(spark: SparkSession, variations=(0.0, 0.1, 0.25, 0.5, 1.0), repeats: int = 50, n: int = 2000, base: float = 1e-4, seed: int = 42, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """Latency and detection figures of three trackers when the mean interval halves midway, over variations of the intervals."""

    def alarms(name: str, z: np.ndarray) -> np.ndarray:
        if name == "CUSUM":
            return recurrences.cusum(z, threshold, drift)[2]
        if name == "Kalman":
            residual = recurrences.kalman(z, 7.4e-14, 1.85e-15, 1e-12)["kalman_innovation"]
        else:
            local = np.array([z[max(0, i - 9) : i + 1].var() for i in range(len(z))]) + 1e-30
            s = recurrences.linear(z, np.clip(0.2 * local / (z.var() + 1e-30), 0.05, 0.8))
            residual = z - s
        half = residual[: len(z) // 2]
        return np.abs(residual - half.mean()) > 3 * (half.std() + 1e-30)

    def run(batches):
        for pdf in batches:
            rows = []
            for r, cv in zip(pdf["run"], pdf["variation"]):
                g = np.random.default_rng([seed, int(r), int(cv * 1000)])
                draw = lambda mean, k: np.full(k, mean) if cv <= 0 else g.gamma(1 / cv**2, mean * cv**2, k)  # noqa: B023, E731
                half = n // 2
                z = np.concatenate((draw(base, half), draw(base / 2, n - half)))
                for name in ("Kalman", "AdaptiveEWMA", "CUSUM"):
                    at = np.flatnonzero(alarms(name, z))
                    tp, fp = int((at >= half).sum()), int((at < half).sum())
                    rows.append((name, cv, float(at[at >= half][0] - half if tp else n - half), *_rates(tp, fp, n - half, half)))
            yield pd.DataFrame(rows, columns=["algorithm", "variation", "latency", "precision", "recall", "f1_score", "fpr"])

    out = _cells(spark, {"variation": [float(v) for v in variations]}, repeats)
    out = out.mapInPandas(run, "algorithm string, variation double, latency double, precision double, recall double, f1_score double, fpr double")
    return out.groupBy("algorithm", "variation").agg(*[F.avg(c).alias(c) for c in ("latency", "precision", "recall", "f1_score", "fpr")])


#: Trackers whose cost is measured.
KERNELS = {
    "kalman": lambda z: recurrences.kalman(z, 7.4e-14, 1.85e-15, 1e-12),
    "adaptive_ewma": lambda z: recurrences.linear(z, np.full(len(z), 0.2)),
    "cusum": lambda z: recurrences.cusum(z),
}


def complexity(kernel, sizes=(256, 512, 1024, 2048, 4096), repeats: int = 5, resamples: int = 1000, seed: int = 42) -> dict:
    """Exponent of a power law through median run times over sizes, with its bootstrap interval. Runs where it is called."""
    r = np.random.default_rng(seed)
    times = []
    for n in sizes:
        x = r.exponential(1e-4, n)
        kernel(x)
        one = []
        for _ in range(repeats):
            begin = time.perf_counter()
            kernel(x)
            one.append(time.perf_counter() - begin)
        times.append(float(np.median(one)))
    logs, y = np.log(sizes), np.log(np.maximum(times, 1e-9))
    slopes = []
    for _ in range(resamples):
        i = r.integers(0, len(sizes), len(sizes))
        if len(set(i.tolist())) > 1:
            slopes.append(np.polyfit(logs[i], y[i], 1)[0])
    b, a = np.polyfit(logs, y, 1)
    return {"sizes": list(sizes), "seconds": times, "exponent": float(b), "scale": float(np.exp(a)), "ci_low": float(np.percentile(slopes, 2.5)), "ci_high": float(np.percentile(slopes, 97.5))}
