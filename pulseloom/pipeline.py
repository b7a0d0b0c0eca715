"""Entry points: a campaign of segment files, one channel's event table, a campaign of many data sets, a batch of files, and synthetic studies."""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions import dsp, recurrences
from pulseloom.operators import campaign, detect, features, intervals, rolling, studies, track
from pulseloom.session import build_session
from pulseloom.sources import sinks, waveform_files

BANDS_GHZ = [(0.0, 0.5), (0.5, 1.5), (1.5, 2.4)]
K_SIGMA = [3.0, 5.0, 7.0]
FILE_TYPES = (".csv", ".mat", ".h5", ".hdf5")


def segment_pulses(segments: DataFrame) -> DataFrame:
    """Denoised array segments to pulses: campaign, segment_id, trigger_epoch, t_s."""

    def run(batches):
        for pdf in batches:
            rows = [(p, t, float(i) / fs) for p, t, fs, x in zip(pdf["path"], pdf["trigger_epoch"], pdf["fs_hz"], pdf["samples"]) for i in dsp.cfar(dsp.denoise(np.asarray(x, float)))]
            yield pd.DataFrame(rows, columns=["segment_id", "trigger_epoch", "t_s"])

    out = segments.select("path", "trigger_epoch", "fs_hz", "samples").mapInPandas(run, "segment_id string, trigger_epoch double, t_s double")
    return out.withColumn("campaign", F.lit("campaign"))


def empirical(spark: SparkSession, directory: str, pattern: str = "*.csv", default_fs: float = 5e9, least: int = 5) -> DataFrame | None:
    """Files to tracked intervals with dead time between files; None when there are fewer than ``least``. Files that can't be read are left out."""
    files = waveform_files.load(spark, directory, default_fs, pattern=pattern).filter("error IS NULL")
    stitched = intervals.stitch(segment_pulses(files))
    order = Window.partitionBy("campaign").orderBy("trigger_epoch", "segment_id", "part")
    rows = stitched.withColumns({"k": (F.row_number().over(order) - 1).cast("long"), "series_id": F.lit(0).cast("long")})
    return track.unified(rows) if rows.count() >= least else None


def material(pulses: DataFrame, max_valid_dt_s: float = 1.0, window: int = 50, boundaries: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(event table, summary by stage) of detected pulses (series_id, k, toa_s, peak_v)."""
    events = intervals.flag_outliers(intervals.log_rate(intervals.delta_t(pulses)), max_valid_dt_s)
    events = rolling.burstiness(rolling.rolling_rates(events, window), window)
    events = rolling.window_ids(rolling.weibull(events, window), window)
    events = rolling.stages(events, boundaries) if boundaries else rolling.auto_stages(events)
    return events, campaign.group_summary(events, "stage")


def _slices(events: DataFrame, samples: DataFrame, group: str, fs: float, noise: int) -> DataFrame:
    """The summary of a group of events, with energy and SNR of the samples between its first and last event."""
    ends = events.groupBy("series_id", F.col(group).alias("grp")).agg(F.floor(F.min("toa_s") * fs).alias("first_idx"), F.floor(F.max("toa_s") * fs).alias("last_idx"))
    metrics = campaign.slice_metrics(samples, ends, fs, noise=noise).drop("series_id").withColumnRenamed("grp", group)
    return campaign.group_summary(events, group).join(metrics, group, "left").fillna(0.0, ["mean_energy", "mean_snr_db"]).orderBy(group)


def material_run(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """One channel of a data set: event table, summaries by window and by stage or segment, and detections by threshold and cut-off if asked for.

    config: base_dir, dataset (folder, channel), preprocess, detection and
    analysis. Without two pulses there are no tables.
    """
    pre, found, asked = config["preprocess"], config["detection"], config["analysis"]
    path = f"{config['base_dir']}/{config['dataset']['folder']}"
    files = waveform_files.load(spark, path, preserve_amplitude=pre.get("preserve_amplitude", True), pattern=f"{config['dataset']['channel']}.csv", recursive=False)
    row = files.select("fs_hz", "error").first()
    if row is None or row["error"]:
        raise ValueError(row["error"] if row else f"no {config['dataset']['channel']}.csv in {path}")
    fs, separation, window = row["fs_hz"], found["refractory_ns"] * 1e-9, asked["rolling_window_events"]
    signal = files.select(F.lit(0).cast("long").alias("series_id"), "samples", "times", "fs_hz")
    if pre.get("wavelet_denoise", False):
        signal = detect.denoise(signal, "db4")
    at = detect.array_pulses(signal, fs, found["k_sigma"], separation)
    times = signal.select("series_id", F.posexplode("times").alias("pos", "time")).select("series_id", F.col("pos").cast("long").alias("idx"), "time")
    pulses = at.join(times, ["series_id", "idx"], "left").select("series_id", F.col("pulse_no").alias("k"), F.coalesce("time", F.col("idx") / fs).alias("toa_s"), "peak_v")
    if pulses.count() < 2:
        return {}
    boundaries, aware = asked.get("stage_boundaries_s"), asked.get("stage_aware", False) and "stage_boundaries_s" in asked
    fixed = boundaries if isinstance(boundaries, list) else None
    events, _ = material(pulses, asked.get("max_valid_dt_s", 1.0), window, fixed)
    events = intervals.fold_phase(events, 50.0).drop("signed_v").withColumnRenamed("phase_deg", "prpd_phase_deg")
    group = "stage" if fixed else "segment"
    events = events.withColumnRenamed("stage", group) if aware else events.drop("stage")
    events = events.withColumn("event_idx", F.col("k") + 1).cache()
    samples = detect.to_long(signal.select("series_id", "samples"))
    noise = max(16, int(found["noise_window_ns"] * 1e-9 * fs)) if found.get("noise_window_ns") else 64
    out = {"delta_t_series_master": events.orderBy("event_idx"), "window_id_summary": _slices(events, samples, "window_id", fs, noise)}
    if aware:
        out[f"{group}_summary"] = _slices(events, samples, group, fs, noise)
    if asked.get("export_sensitivity_report", False):
        # Thresholds and cut-offs of the report.
        out["sensitivity_report"] = campaign.detection_sensitivity(signal, [4.0, 5.0, 6.0], [0.1, 0.5, 1.0], separation).drop("series_id")
    return out


def _file_metrics(files: DataFrame, keys: list[str], analysis: dict) -> DataFrame:
    """Time metrics of the signals, and spectral metrics and intervals of the signals after the denoising that is asked for; a row for each file."""
    denoise = analysis.get("denoise") or {}
    files = files.withColumn("series_id", F.xxhash64("path"))
    cleaned = files.select("series_id", "samples", "fs_hz")
    if denoise.get("enabled", False):
        cleaned = detect.denoise(cleaned, denoise.get("wavelet", "db4"), denoise.get("threshold_mode", "soft"), denoise.get("threshold_rule", "universal"))
    timed = campaign.time_metrics(detect.to_long(files.select("series_id", "fs_hz", "samples")), F.col("fs_hz"), analysis.get("noise_window_ns"))
    spectral = campaign.spectral_metrics(campaign.spectrum(cleaned, "fs_hz"), [tuple(b) for b in analysis.get("bands_ghz", BANDS_GHZ)])
    method = {"scipy_peaks": "prominence"}.get(m := str(analysis.get("delta_t_detection_method", "cfar")), m)
    gaps = detect.delta_t_vector(cleaned, "fs_hz", float(analysis.get("delta_t_threshold_sigma", 3.0)), 0.0, method)
    gaps = gaps.groupBy("series_id").agg(F.count("*").alias("delta_t_count"), F.avg("delta_t_s").alias("mean_delta_t_s"))
    out = files.select("series_id", *keys, F.col("path").alias("file_path"), "fs_hz", F.col("trigger_epoch").alias("trigger_time_epoch"))
    out = out.join(gaps, "series_id", "left").fillna(0, ["delta_t_count"]).join(timed, "series_id").join(spectral, "series_id")
    return out.drop("series_id")


def _tables(metrics: DataFrame, keys: list[str], curve_keys: list[str], ks: list[float]) -> dict[str, DataFrame]:
    numbers = [c for c, t in metrics.dtypes if t in ("double", "bigint", "int") and c != "trigger_time_epoch"]
    curves = campaign.detection_curves(metrics, curve_keys, ks)
    reported = [k for k in K_SIGMA if k in ks]
    return {"metrics": metrics, "summary": campaign.mean_median(metrics, keys, numbers), "detection_curves": curves, "detection_summary": campaign.pivot_curves(curves, curve_keys, reported)}


def dataset_campaign(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Metrics of all files of all data sets, their means and medians, detection curves, and the pivoted curves.

    config: base_dir, datasets (folder, label, mode and channel_map each) and
    analysis_params. Every file goes by its own rate. A folder that is not there
    is an error; files that can't be read are too.
    """
    analysis, base = config.get("analysis_params") or {}, str(config["base_dir"]).rstrip("/")
    found = None
    for key, d in (config.get("datasets") or {}).items():
        files = waveform_files.load(spark, f"{base}/{d['folder']}", float(analysis.get("default_fs", 1e9)), bool(analysis.get("preserve_amplitude", True)), "*.csv")
        channels = {str(c): a for c, a in (d.get("channel_map") or {}).items()}
        files = campaign.channel_map(waveform_files.channel_files(files, sorted(channels), per_folder=False), channels)
        files = files.withColumns({"dataset_key": F.lit(str(key)), "dataset_label": F.lit(d.get("label", d["folder"])), "mode": F.lit(d.get("mode", "benchmark"))})
        found = files if found is None else found.unionByName(files)
    if found is None:
        raise ValueError("the configuration names no data sets")
    found = found.withColumn("samples", F.when(F.col("error").isNull(), F.col("samples")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error"))))
    metrics = _file_metrics(found, ["dataset_key", "dataset_label", "mode", "channel", "antenna"], analysis)
    return _tables(metrics, ["dataset_key", "dataset_label", "mode", "antenna"], ["dataset_key", "antenna"], [float(k) for k in analysis.get("detection_k_values", K_SIGMA)])


def file_campaign(spark: SparkSession, directory: str, channels: dict[str, str], bands: list[tuple[float, float]], ks: list[float], noise_ns: float | None = None, default_fs: float = 1e9) -> dict[str, DataFrame]:
    """The same tables for one directory and one map of channels, by antenna; the pivoted curves have a column for each of ks."""
    files = waveform_files.load(spark, directory, default_fs, preserve_amplitude=True, pattern="*.csv").filter("error IS NULL")
    files = campaign.channel_map(waveform_files.channel_files(files, sorted(channels)), channels)
    metrics = _file_metrics(files, ["channel", "antenna"], {"bands_ghz": bands, "noise_window_ns": noise_ns})
    out = _tables(metrics, ["antenna"], ["antenna"], ks)
    return {"metrics": out["metrics"], "summary": out["summary"], "curves": out["detection_curves"], "pivot": campaign.pivot_curves(out["detection_curves"], ["antenna"], ks)}


def _stem(path: str) -> str:
    return PurePosixPath(path).stem


# Columns of the report on a file.
VALIDATION = "file_name string, signal_length_samples long, sampling_frequency_hz double, duration_seconds double, n_pulses_detected long, mean_interpulse_time_s double, std_interpulse_time_s double, kalman_steady_gain double, cusum_total_alarms long, error string"


def validate_files(spark: SparkSession, directory: str, pattern: str = "*.*", known_change_times: dict[str, float] | None = None, wavelet: str = "db4", mode: str = "soft", rule: str = "universal", default_fs: float = 1e9) -> DataFrame:
    """A row for each capture in a directory: its intervals after denoising, the filter's last gain and CUSUM's alarms.

    A file that can't be read or has fewer than three intervals has its name
    and an error only. known_change_times adds change_time_s by name.
    """
    files = waveform_files.load(spark, directory, default_fs, pattern=pattern, recursive=False)
    files = files.filter(" OR ".join(f"lower(path) LIKE '%{t}'" for t in FILE_TYPES))
    q, r, p0 = 7.4e-14, 1.85e-15, 1e-12

    def of(path: str, fs: float, samples, error: str | None) -> tuple:
        name, nothing = _stem(path), [None] * 8
        if error:
            return name, *nothing, error
        x = np.asarray(samples, float)
        gaps = dsp.intervals(dsp.denoise(x, wavelet, mode, rule), fs, 3.0, 0.0, "prominence")
        if len(gaps) < 3:
            return name, *nothing, f"too few pulses for tracking: {len(gaps) + 1 if len(gaps) else 0}"
        tracked = recurrences.kalman(gaps, q, r, p0)
        alarms = recurrences.cusum(tracked["kalman_z"], 8.0, 0.5)[2]
        return name, len(x), fs, len(x) / fs, len(gaps) + 1, float(gaps.mean()), float(gaps.std()), float(1 - r / tracked["kalman_variance"][-1]), int(alarms.sum()), None

    names = [c.split()[0] for c in VALIDATION.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([of(*row) for row in zip(pdf["path"], pdf["fs_hz"], pdf["samples"], pdf["error"])], columns=names).astype({c: "Int64" for c in ("signal_length_samples", "n_pulses_detected", "cusum_total_alarms")})

    out = files.select("path", "fs_hz", "samples", "error").mapInPandas(run, VALIDATION)
    times = sorted((known_change_times or {}).items())
    known = spark.createDataFrame([(k, float(v)) for k, v in times], "file_name string, change_time_s double")
    return out.join(F.broadcast(known), "file_name", "left")


def descriptor_report(spark: SparkSession, directory: str, known_change_times: dict[str, float], pattern: str = "*.*", size: int = 1024, overlap: int = 512, default_fs: float = 1e9) -> DataFrame:
    """How well each descriptor of denoised captures detects the change at its known time: a row for each file and descriptor."""
    files = waveform_files.load(spark, directory, default_fs, pattern=pattern, recursive=False).filter("error IS NULL")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    known = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in sorted(known_change_times.items())], "name string, change_time_s double"))
    files = files.withColumn("name", stem).join(known, "name").withColumn("series_id", F.xxhash64("path"))
    samples = detect.to_long(detect.denoise(files.select("series_id", "samples"), "db4", "soft", "universal"))
    places = F.broadcast(files.select("series_id", "name", F.floor(F.col("change_time_s") * F.col("fs_hz") / (size - overlap)).alias("change_window")))
    values = features.long_form(features.descriptors(samples, size, overlap)).join(places, "series_id")
    return features.ablation(values, F.col("change_window")).join(places.select("series_id", "name"), "series_id").drop("series_id")


def synthetic_run(spark: SparkSession, n: int = 4096, fs: float = 1e9, iterations: int = 100, seed: int = 42) -> dict:
    """The four phases on a synthetic signal: the best denoising, its intervals, their tracking, and the trackers' cost and convergence."""
    clean, noisy = dsp.synthesize(n, fs, 12, 20.0, seed)
    grid = studies.denoising_grid(spark, iterations, n, fs, seed=seed).cache()
    best = studies.best_cell(grid).first()
    cleaned = dsp.denoise(noisy, best["wavelet"], best["mode"], best["rule"])
    gaps = dsp.intervals(cleaned, fs)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(gaps)], "series_id long, k long, delta_t_s double")
    cost = {name: studies.complexity(kernel) for name, kernel in studies.KERNELS.items()}
    return {"clean": clean, "noisy": noisy, "filtered": cleaned, "fs": fs, "grid": grid, "best": best.asDict(), "intervals": rows, "tracking": track.unified(rows), "complexity": cost, "convergence": studies.convergence_study(spark, seed=seed)}


def _write_synthetic(out: str, found: dict) -> None:
    sinks.write_signals(f"{out}/signals.npz", found["clean"], found["noisy"], found["fs"])
    metrics = {k: v for k, v in found["best"].items()} | {f"{name}_exponent": c["exponent"] for name, c in found["complexity"].items()}
    sinks.write_metrics(out, metrics, found["intervals"])
    sinks.write_text(f"{out}/denoising_grid.tex", sinks.latex_table(found["grid"].orderBy("mean_rmse"), "Denoising grid", "tab:grid"))
    sinks.write_text(f"{out}/convergence.tex", sinks.latex_table(found["convergence"].orderBy("algorithm", "variation"), "Convergence", "tab:convergence"))
    sinks.write_parquet(found["tracking"], f"{out}/tracking")


def main(argv: list[str] | None = None) -> int:
    """spark-submit entry: run-empirical DIRECTORY OUT, run-campaign CONFIG OUT, run-material CONFIG OUT, run-files DIRECTORY OUT, run-legacy OUT."""
    parser = argparse.ArgumentParser(prog="pulseloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run-empirical", "run-campaign", "run-material", "run-files"):
        one = commands.add_parser(name)
        one.add_argument("path")
        one.add_argument("out")
        if name == "run-files":
            one.add_argument("--change", action="append", default=[], metavar="NAME=SECONDS", help="known change time of a capture: adds the report of its descriptors")
    legacy = commands.add_parser("run-legacy")
    legacy.add_argument("out")
    legacy.add_argument("-n", "--n-samples", type=int, default=4096)
    legacy.add_argument("--fs", type=float, default=1e9)
    legacy.add_argument("--mc-iterations", type=int, default=100)
    legacy.add_argument("--seed", type=int, default=42)
    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "run-empirical":
        tracked = empirical(spark, args.path)
        if tracked is None:
            return 1
        sinks.export_parquet(tracked, args.out, "tracking")
        return 0
    if args.command == "run-files":
        known = {name: float(at) for name, _, at in (c.rpartition("=") for c in args.change)}
        sinks.write_json(validate_files(spark, args.path, known_change_times=known), f"{args.out}/summaries")
        if known:
            sinks.write_csv(descriptor_report(spark, args.path, known), f"{args.out}/descriptor_report", single=True)
        return 0
    if args.command == "run-legacy":
        _write_synthetic(args.out, synthetic_run(spark, args.n_samples, args.fs, args.mc_iterations, args.seed))
        return 0
    config = waveform_files.load_config(args.path)
    tables = material_run(spark, config) if args.command == "run-material" else dataset_campaign(spark, config)
    if not tables:
        return 1
    for name, df in tables.items():
        sinks.write_csv(df, f"{args.out}/{name}", single=True)
    if "delta_t_series_master" in tables:
        outliers = tables["delta_t_series_master"].agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers")).first()
        sinks.write_manifest(f"{args.out}/run_manifest.json", config, {"total_events": outliers["n"], "valid_events": outliers["n"] - outliers["outliers"], "outlier_events": outliers["outliers"]})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
