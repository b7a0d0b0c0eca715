"""Campaign tables: time and spectral metrics, group summaries, detection curves, sensitivity grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import dsp
from pulseloom.operators import detect, quantiles


def time_metrics(samples: DataFrame, fs: float | Column, noise_ns: float | None = None) -> DataFrame:
    """vpp, peak, noise RMS of the first samples, SNR, energy and peak over noise of each series; no noise gives infinity.

    fs: one rate, or a column with that of each row's series. The noise is that
    of the first 64 samples, or of a time of at least 16 samples.
    """
    rate = F.lit(fs) if isinstance(fs, (int, float)) else fs
    wanted = F.lit(64) if noise_ns is None else F.greatest(F.lit(16), F.floor(noise_ns * 1e-9 * rate))
    m = samples.groupBy("series_id").agg(
        (F.max("x") - F.min("x")).alias("vpp"), F.max(F.abs("x")).alias("peak_abs"),
        F.sqrt(F.avg(F.when(F.col("idx") < wanted, F.col("x") * F.col("x")))).alias("noise_rms"), F.sum(F.col("x") * F.col("x") / rate).alias("energy"),
    )
    over = F.when(F.col("noise_rms") > 0, F.try_divide("peak_abs", "noise_rms")).otherwise(F.lit(float("inf")))
    return m.withColumn("z_peak", over).withColumn("snr_db", F.when(F.col("noise_rms") > 0, 20 * F.log10("z_peak")).otherwise(F.lit(float("inf"))))


def band_name(low: float, high: float) -> str:
    return f"bandpower_{low:.2f}_{high:.2f}GHz".replace(".", "p")


def spectrum(segments: DataFrame, fs: float | str) -> DataFrame:
    """Periodogram of each array segment in long form: series_id, f_no, f_hz, psd. fs: one rate, or the column with each segment's."""

    def run(batches):
        for pdf in batches:
            parts = []
            for sid, x, rate in zip(pdf["series_id"], pdf["samples"], pdf["rate"]):
                f, p = dsp.periodogram(np.asarray(x, float), rate)
                parts.append(pd.DataFrame({"series_id": sid, "f_no": np.arange(len(f)), "f_hz": f, "psd": p}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["series_id", "f_no", "f_hz", "psd"])

    rate = F.col(fs) if isinstance(fs, str) else F.lit(float(fs))
    return segments.select("series_id", "samples", rate.alias("rate")).mapInPandas(run, "series_id long, f_no long, f_hz double, psd double")


def spectral_metrics(spectra: DataFrame, bands_ghz: list[tuple[float, float]]) -> DataFrame:
    """Power in total and by bands (trapezoids within a band), shares, ratio of the last to the first band, centroid."""
    w = Window.partitionBy("series_id").orderBy("f_no")
    area = lambda ok: F.when(ok, (F.col("psd") + F.lag("psd").over(w)) / 2 * (F.col("f_hz") - F.lag("f_hz").over(w)))
    rows, sums = spectra, []
    for i, (low, high) in enumerate(bands_ghz):
        inside = (F.col("f_hz") >= low * 1e9) & (F.lag("f_hz").over(w) >= low * 1e9) & (F.col("f_hz") < high * 1e9)
        rows = rows.withColumn(f"_b{i}", area(inside))
        sums.append(F.coalesce(F.sum(f"_b{i}"), F.lit(0.0)).alias(band_name(low, high)))
    rows = rows.withColumn("_t", area(F.lag("f_hz").over(w).isNotNull()))
    centre = F.coalesce(F.try_divide(F.sum(F.col("f_hz") * F.col("psd")), F.nullif(F.sum("psd"), F.lit(0.0))), F.lit(0.0))
    m = rows.groupBy("series_id").agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("spectral_total_power"), *sums, centre.alias("spectral_centroid_hz"))
    total = F.col("spectral_total_power")
    for low, high in bands_ghz:
        n = band_name(low, high)
        m = m.withColumn(n + "_share", F.when(total > 0, F.try_divide(F.col(n), total)).otherwise(0.0))
    if len(bands_ghz) >= 2:
        first, last = F.col(band_name(*bands_ghz[0])), F.col(band_name(*bands_ghz[-1]))
        m = m.withColumn("ratio_high_low", F.when(first > 0, F.try_divide(last, first)).otherwise(F.lit(float("inf"))))
    return m


def mean_median(metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and median of each value by keys; null keys are groups too."""
    return metrics.groupBy(*keys).agg(*[a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.percentile(v, F.lit(0.5)).alias(f"{v}_median"))])


def detection_curves(metrics: DataFrame, keys: list[str], ks: list[float], score: str = "z_peak") -> DataFrame:
    """Share of files whose score reaches k, for each group and k; scores that aren't numbers don't count."""
    spark = metrics.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(k),) for k in ks], "k_sigma double"))
    valid = metrics.filter(F.col(score).isNotNull() & ~F.isnan(score)).join(grid)
    share = F.avg((F.col(score) >= F.col("k_sigma")).cast("double"))
    return valid.groupBy(*keys, "k_sigma").agg(share.alias("pd")).withColumn("pd_percent", 100 * F.col("pd"))


def curve_name(k: float) -> str:
    """pd_3sigma_percent, pd_1p5sigma_percent."""
    return f"pd_{k:g}sigma_percent".replace(".", "p")


def pivot_curves(curves: DataFrame, keys: list[str], ks: list[float]) -> DataFrame:
    """One column for each k."""
    wide = curves.groupBy(*keys).pivot("k_sigma", [float(k) for k in ks]).agg(F.first("pd_percent"))
    return wide.select(*keys, *[F.col(f"`{float(k)}`").alias(curve_name(k)) for k in ks])


_SHARES = {"_q25": 0.25, "_q50": 0.5, "_q75": 0.75, "_q90": 0.9}


def group_summary(events: DataFrame, group: str, accuracy: int | None = None) -> DataFrame:
    """Counts, median, quartile range, 90 % quantile and variation of valid intervals, and the mean rolling rate; zeros for a group of outliers.

    Quantiles are exact (``quantiles.group_quantiles``: the events are written
    once, and large groups refined); with an accuracy they are sketches of
    bounded size whose ranks err by at most 1 / accuracy.
    """
    v = F.col("valid_dt")
    if accuracy is None:
        events = quantiles.written(events.select(group, v, "is_outlier", "rolling_rate_hz"), "events")
    sketch = [] if accuracy is None else [F.percentile_approx(v, p, accuracy).alias(c) for c, p in _SHARES.items()]
    s = events.groupBy(group).agg(
        F.count("*").alias("n_events"), F.count(v).alias("n_valid_events"), F.count_if("is_outlier").alias("n_outliers"),
        F.try_divide(F.stddev_samp(v), F.nullif(F.avg(v), F.lit(0.0))).alias("cv_dt"), F.avg("rolling_rate_hz").alias("mean_smoothed_rate"), *sketch,
    )
    if accuracy is None:
        q = quantiles.group_quantiles(events, group, "valid_dt", _SHARES)
        s = s.join(q, s[group].eqNullSafe(q[group]), "left").drop(q[group])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select(
        group, "n_events", "n_valid_events", "n_outliers", zero(F.col("_q50")).alias("median_dt"), zero(F.col("_q75") - F.col("_q25")).alias("iqr_dt"), zero(F.col("_q90")).alias("p90_dt"),
        F.when(F.col("n_valid_events") == 0, 0.0).otherwise(F.col("cv_dt")).alias("cv_dt"), zero(F.col("mean_smoothed_rate")).alias("mean_smoothed_rate"),
    )


#: Samples of a stretch by which slices are joined.
_STRETCH = 4096


def slice_metrics(samples: DataFrame, groups: DataFrame, fs: float, least: int = 100, noise: int = 64) -> DataFrame:
    """Energy and SNR of the samples in [first_idx, last_idx) of each group, 0 for a slice that is too short.

    groups: series_id, grp, first_idx, last_idx. An equi-join on stretches of the series, so that a sample meets the
    groups that reach into its stretch.
    """
    stretch = lambda c: F.floor(c / F.lit(_STRETCH))
    reach = F.sequence(stretch(F.col("first_idx")), stretch(F.col("last_idx") - 1))
    groups = groups.filter("last_idx > first_idx").withColumn("_part", F.explode(reach))
    rows = samples.withColumn("_part", stretch(F.col("idx"))).join(groups, ["series_id", "_part"]).filter("idx >= first_idx AND idx < last_idx")
    early = F.when(F.col("idx") < F.col("first_idx") + noise, F.col("x") * F.col("x"))
    m = rows.groupBy("series_id", "grp").agg(F.count("*").alias("n"), (F.sum(F.col("x") * F.col("x")) / fs).alias("energy"), F.max(F.abs("x")).alias("_p"), F.sqrt(F.avg(early)).alias("_s"))
    long_ = F.col("n") > least
    return m.select("series_id", "grp", F.when(long_, F.col("energy")).otherwise(0.0).alias("mean_energy"), F.when(long_ & (F.col("_s") > 0), 20 * F.log10(F.try_divide("_p", "_s"))).otherwise(0.0).alias("mean_snr_db"))


def sensitivity_grid(pulses: DataFrame, ks: list[float], cuts: list[float], scale: str = "peak_v") -> DataFrame:
    """Total, valid and outlier intervals for each threshold (mean + k sigma of the peaks) and cut-off."""
    spark = pulses.sparkSession
    # Summed in the order of k, so that how rows are dealt to tasks doesn't decide on a peak that is equal to the mean.
    whole = Window.partitionBy("series_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limited = pulses.withColumns({"_m": F.avg(scale).over(whole), "_s": F.stddev_pop(scale).over(whole)})
    grid = F.broadcast(spark.createDataFrame([(float(k),) for k in ks], "k_sigma double"))
    kept = limited.join(grid).filter(F.col(scale) >= F.col("_m") + F.col("k_sigma") * F.col("_s"))
    w = Window.partitionBy("series_id", "k_sigma").orderBy("k")
    gaps = kept.withColumn("dt", F.col("toa_s") - F.lag("toa_s").over(w)).filter("dt IS NOT NULL")
    each = F.broadcast(spark.createDataFrame([(float(c),) for c in cuts], "max_valid_dt_s double"))
    out = F.count_if(F.col("dt") > F.col("max_valid_dt_s"))
    return gaps.join(each).groupBy("k_sigma", "max_valid_dt_s").agg(F.count("*").alias("total_events"), (F.count("*") - out).alias("valid_events"), out.alias("outliers"))


def channel_map(pulses: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Adds the antenna of each channel; a channel that is not mapped has none."""
    names = F.broadcast(pulses.sparkSession.createDataFrame(sorted(mapping.items()), "channel string, antenna string"))
    return pulses.join(names, "channel", "left")


def zscore_diagnostics(tracked: DataFrame, z: str = "kalman_z") -> DataFrame:
    over = 100 * F.avg((F.abs(z) > 3).cast("double"))
    return tracked.groupBy("series_id").agg(F.avg(z).alias("z_mean"), F.stddev_pop(z).alias("z_std"), over.alias("pct_above_3"))


def file_summary(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("series_id").agg(
        (F.count("*") + 1).alias("n_pulses"), F.count("*").alias("n_intervals"), F.avg("delta_t_s").alias("mean_dt"), F.stddev_pop("delta_t_s").alias("std_dt"),
        F.count_if("alarm").alias("n_alarms"), F.coalesce(F.max("alarm"), F.lit(False)).alias("change_detected"),
    )


def detection_sensitivity(segments: DataFrame, ks: list[float], cuts: list[float], separation_s: float = 0.0, fs: str = "fs_hz") -> DataFrame:
    """Total, valid and outlier intervals of array segments for each threshold and cut-off; each threshold detects anew.

    A segment with fewer than two pulses at a threshold gives no row for it.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for sid, rate, x in zip(pdf["series_id"], pdf["rate"], pdf["samples"]):
                for k in ks:
                    gaps = np.diff(dsp.detect(np.asarray(x, float), rate, k, separation_s)) / rate
                    rows += [(sid, float(k), float(c), len(gaps), int((gaps <= c).sum()), int((gaps > c).sum())) for c in cuts if len(gaps)]
            yield pd.DataFrame(rows, columns=["series_id", "k_sigma", "max_valid_dt_s", "total_events", "valid_events", "outliers"])

    chosen = segments.select("series_id", F.col(fs).alias("rate"), "samples")
    return chosen.mapInPandas(run, "series_id long, k_sigma double, max_valid_dt_s double, total_events long, valid_events long, outliers long")


def threshold_sensitivity(samples: DataFrame, ks: list[float], cuts: list[float], fs: float) -> DataFrame:
    """Total, valid and outlier intervals of each sampled waveform for each threshold and cut-off; each threshold detects anew.

    Maxima are the same for all thresholds and found once, by the lowest one; a
    waveform with fewer than two pulses at a threshold gives no row for it. No
    refractory time: ``detection_sensitivity`` has one, for array segments.
    """
    spark = samples.sparkSession
    limits = samples.groupBy("series_id").agg(F.avg(F.abs("x")).alias("_m"), F.stddev_pop(F.abs("x")).alias("_s"))
    grid = F.broadcast(spark.createDataFrame([(float(k),) for k in ks], "k_sigma double"))
    found = detect.threshold_peaks(samples, min(ks)).join(limits, "series_id").join(grid).filter(F.col("peak_v") >= F.col("_m") + F.col("k_sigma") * F.col("_s"))
    w = Window.partitionBy("series_id", "k_sigma").orderBy("idx")
    gaps = found.withColumn("dt", (F.col("idx") - F.lag("idx").over(w)) / fs).filter("dt IS NOT NULL")
    each = F.broadcast(spark.createDataFrame([(float(c),) for c in cuts], "max_valid_dt_s double"))
    valid = F.count_if(F.col("dt") <= F.col("max_valid_dt_s"))
    return gaps.join(each).groupBy("series_id", "k_sigma", "max_valid_dt_s").agg(F.count("*").alias("total_events"), valid.alias("valid_events"), (F.count("*") - valid).alias("outliers"))


def phase_density(phases: DataFrame, bandwidth: float = 0.15, sample: int = 5000, seed: int = 1) -> DataFrame:
    """Gaussian kernel density of (phase_deg, signed_v) at each pulse, weighted by magnitude, from a bounded seeded sample of pulses.

    The kernel's covariance is the sample's weighted one times the bandwidth's
    square. No density (null) for a sample without spread.
    """
    some = phases.select("phase_deg", "signed_v").orderBy(F.xxhash64(F.lit(seed), "phase_deg", "signed_v")).limit(sample).collect()
    points = np.array([[r["phase_deg"], r["signed_v"]] for r in some], float).reshape(-1, 2)
    weights = np.abs(points[:, 1])
    scale = None
    if len(points) > 2 and weights.sum() > 0:
        weights = weights / weights.sum()
        covariance = np.cov(points.T, aweights=weights) * bandwidth**2
        if np.linalg.matrix_rank(covariance) == 2:
            scale = np.linalg.inv(covariance), 1 / (2 * np.pi * np.sqrt(np.linalg.det(covariance)))

    @F.pandas_udf("double")
    def density(phase: pd.Series, volts: pd.Series) -> pd.Series:
        if scale is None:
            return pd.Series([None] * len(phase), dtype=float)
        out = []
        for at in range(0, len(phase), 1024):
            d = np.stack((phase.to_numpy()[at : at + 1024], volts.to_numpy()[at : at + 1024]), axis=1)[:, None, :] - points[None, :, :]
            out.append(np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, scale[0], d)) @ weights * scale[1])
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return phases.withColumn("density", density("phase_deg", "signed_v"))
