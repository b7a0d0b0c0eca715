"""Files in, tables out."""

import struct
import zlib

import numpy as np
import pytest

from pulseloom import pipeline
from pulseloom.sources import sinks
from pulseloom.sources import waveform_files as w


def element(kind, payload):
    return struct.pack("<II", kind, len(payload)) + payload + b"\0" * (-len(payload) % 8)


def mat(**variables):
    out = b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"
    for name, v in variables.items():
        v = np.atleast_2d(np.asarray(v, float))
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *v.shape)) + element(1, name.encode()) + element(9, v.tobytes("F"))
        packed = zlib.compress(element(14, body))
        out += struct.pack("<II", 15, len(packed)) + packed
    return out


def test_oscilloscope_text(spark, tmp_path):
    (tmp_path / "scope.csv").write_text("Model,X\nDate:,19 NOV 2025\nTime:,14:23:42\nTime,CH3\n0,0.016\n1e-9,0.5\n2e-9,-0.5\n3e-9,0.1\n4e-9,0.2\n")
    row = w.load(spark, str(tmp_path), preserve_amplitude=True).first()
    assert len(row["samples"]) == 5 and abs(row["fs_hz"] - 1e9) < 1 and row["trigger_epoch"] == 1763562222.0
    assert abs(sum(row["samples"])) < 1e-12


def test_text_shapes():
    x, fs, trigger, times = w.parse_text("voltage\n1\n2\n3\n", 7.0)
    assert x.tolist() == [1, 2, 3] and fs == 7.0 and trigger == 0 and times is None
    x, _, _, times = w.parse_text("0,1,2,3\n1,4,3,5\n", 1.0)
    assert x.tolist() == [1, 4, 3, 5] and times.tolist() == [0, 1, 2, 3]
    x, _, _, _ = w.parse_text('0,,1,9\n1,"2",9\n', 1.0)
    assert x.tolist() == [1, 2]
    for bad in ("", "a,b\n", "0,1,9\n2,,9\n"):
        with pytest.raises(ValueError):
            w.parse_text(bad, 1.0)


def test_mat_files(spark, tmp_path):
    x = np.sin(np.arange(300))
    (tmp_path / "a.mat").write_bytes(mat(data=x, fs=2.5e9))
    row = w.load(spark, str(tmp_path)).first()
    assert row["fs_hz"] == 2.5e9 and np.allclose(np.array(row["samples"]), (x - x.mean()) / np.abs(x - x.mean()).max())
    with pytest.raises(ValueError):
        w.parse("a.txt", b"", 1.0, False)


def test_channel_lookup_and_campaign(spark, tmp_path):
    r = np.random.default_rng(0)
    for name, scale in (("CH2.csv", 1), ("x_CH2_old.csv", 9), ("run_CH3.csv", 2)):
        x = r.normal(0, 0.1, 400)
        x[200] = 5 * scale
        (tmp_path / name).write_text("t,v\n" + "\n".join(f"{i}e-9,{v}" for i, v in enumerate(x)))
    out = pipeline.file_campaign(spark, str(tmp_path), {"CH2": "A", "CH3": "B"}, [(0.0, 0.2), (0.2, 0.5)], [3.0, 5.0])
    metrics = {m["antenna"]: m for m in out["metrics"].collect()}
    assert set(metrics) == {"A", "B"} and metrics["A"]["peak_abs"] < 6
    assert out["pivot"].columns == ["antenna", "pd_3sigma_percent", "pd_5sigma_percent"]
    assert "antenna" in sinks.text_table(out["pivot"], "Curves") and "\\hline" in sinks.latex_table(out["pivot"], "c", "l")


def pulsed(r, n=3000, gap=400, scale=5.0):
    x = r.normal(0, 0.01, n)
    x[300::gap] = scale
    return x


def table(x, step="e-9"):
    return "t,v\n" + "\n".join(f"{i}{step},{v}" for i, v in enumerate(x))


def test_campaign_of_data_sets(spark, tmp_path):
    r = np.random.default_rng(1)
    rates = {"CH2": "e-9", "CH3": "e-9", "CH4": "e-6"}
    for i, (name, step) in enumerate(rates.items()):
        folder = tmp_path / "raw" / "run one" / f"part{i}"
        folder.mkdir(parents=True)
        (folder / f"{name}.csv").write_text(table(pulsed(r, scale=5.0 * (i + 1)), step))
    config = {
        "base_dir": str(tmp_path / "raw"),
        "datasets": {"d1": {"folder": "run one", "label": "One", "mode": "m", "channel_map": {"CH2": "A", "CH3": "B", "CH4": "C"}}},
        "analysis_params": {"denoise": {"enabled": True}, "detection_k_values": [3.0, 5.0]},
    }
    out = pipeline.dataset_campaign(spark, config)
    assert set(out) == {"metrics", "summary", "detection_curves", "detection_summary"}
    rows = {m["antenna"]: m for m in out["metrics"].collect()}
    assert set(rows) == {"A", "B", "C"} and rows["B"]["vpp"] > rows["A"]["vpp"] and rows["A"]["dataset_label"] == "One"
    assert abs(rows["C"]["fs_hz"] - 1e6) < 1 and abs(rows["A"]["fs_hz"] - 1e9) < 1
    x = w.load(spark, str(tmp_path / "raw"), preserve_amplitude=True, pattern="CH4.csv").first()["samples"]
    assert abs(rows["C"]["energy"] - sum(v * v for v in x) / 1e6) < 1e-9
    assert abs(rows["C"]["noise_rms"] - np.sqrt(np.mean(np.square(x[:64])))) < 1e-12 and rows["A"]["delta_t_count"] > 0
    assert "pd_3sigma_percent" in out["detection_summary"].columns and "vpp_mean" in out["summary"].columns
    with pytest.raises(Exception):
        pipeline.dataset_campaign(spark, config | {"datasets": {"x": {"folder": "none", "channel_map": {"CH2": "A"}}}})["metrics"].count()


def test_batch_keeps_bad_files(spark, tmp_path):
    r = np.random.default_rng(2)
    (tmp_path / "good.csv").write_text(table(pulsed(r)))
    (tmp_path / "bad.csv").write_text("nothing here\n")
    (tmp_path / "flat.csv").write_text(table(np.zeros(500)))
    (tmp_path / "note.txt").write_text("1\n")
    rows = {x["file_name"]: x for x in pipeline.validate_files(spark, str(tmp_path), known_change_times={"good": 1.5e-6}).collect()}
    assert set(rows) == {"good", "bad", "flat"} and rows["bad"]["error"] and rows["flat"]["error"]
    good = rows["good"]
    assert good["error"] is None and good["signal_length_samples"] == 3000 and abs(good["duration_seconds"] - 3e-6) < 1e-12 and good["change_time_s"] == 1.5e-6
    assert 0 < good["kalman_steady_gain"] < 1 and good["n_pulses_detected"] >= 4 and rows["bad"]["n_pulses_detected"] is None
    report = pipeline.descriptor_report(spark, str(tmp_path), {"good": 1.5e-6}, size=256, overlap=128).collect()
    assert {x["name"] for x in report} == {"good"} and len(report) == 12


def test_material_run_and_commands(spark, tmp_path, monkeypatch):
    import yaml

    r = np.random.default_rng(3)
    (tmp_path / "raw" / "a").mkdir(parents=True)
    (tmp_path / "raw" / "a" / "CH1.csv").write_text(table(pulsed(r, 6000, 97, 3.0), "e-6"))
    config = {
        "base_dir": str(tmp_path / "raw"), "dataset": {"folder": "a", "channel": "CH1"}, "preprocess": {"preserve_amplitude": True},
        "detection": {"refractory_ns": 100.0, "k_sigma": 4.0, "noise_window_ns": 2000.0},
        "analysis": {"rolling_window_events": 10, "max_valid_dt_s": 1.0, "stage_aware": True, "stage_boundaries_s": "auto", "export_sensitivity_report": True},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    monkeypatch.setattr(pipeline, "build_session", lambda: spark)
    assert pipeline.main(["run-material", str(tmp_path / "c.yaml"), str(tmp_path / "out")]) == 0
    read = lambda name: spark.read.csv(str(tmp_path / "out" / name), header=True, inferSchema=True)
    events = read("delta_t_series_master")
    assert events.count() == 58 and {"event_idx", "prpd_phase_deg", "segment", "rolling_burstiness"} <= set(events.columns)
    assert read("window_id_summary").count() == 6 and read("segment_summary").filter("mean_energy > 0").count() == 3
    assert read("sensitivity_report").count() == 9 and (tmp_path / "out" / "run_manifest.json").exists()
    assert pipeline.main(["run-files", str(tmp_path / "raw" / "a"), str(tmp_path / "files")]) == 0
    assert pipeline.main(["run-files", str(tmp_path / "raw" / "a"), str(tmp_path / "known"), "--change", "CH1=3e-6"]) == 0
    report = spark.read.csv(str(tmp_path / "known" / "descriptor_report"), header=True, inferSchema=True)
    assert report.count() == 12 and {r["name"] for r in report.select("name").distinct().collect()} == {"CH1"}
    assert spark.read.json(str(tmp_path / "known" / "summaries")).first()["change_time_s"] == 3e-6
    assert pipeline.main(["run-legacy", str(tmp_path / "legacy"), "-n", "1024", "--mc-iterations", "2"]) == 0
    assert {"signals.npz", "metrics.json", "denoising_grid.tex", "convergence.tex", "tracking", "intervals"} <= {x.name for x in (tmp_path / "legacy").iterdir()}


def test_empirical_run(spark, tmp_path):
    r = np.random.default_rng(3)
    for f in range(2):
        x = r.normal(0, 0.01, 3000)
        x[300::400] = 5.0
        (tmp_path / f"seg{f}.csv").write_text(f"Date:,19 NOV 2025\nTime:,14:23:4{f}\n" + "\n".join(f"{i}e-9,{v}" for i, v in enumerate(x)))
    tracked = pipeline.empirical(spark, str(tmp_path))
    assert tracked.count() >= 5 and tracked.filter("delta_t_s > 0.5").count() == 1


def test_config_must_be_a_mapping(tmp_path):
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        w.load_config(str(tmp_path / "c.yaml"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    sinks.write_csv_file(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b")
    path = sinks.export_parquet(df, str(tmp_path), "t")
    assert w.latest(spark, str(tmp_path), "").endswith(".parquet") and spark.read.parquet(path).count() == 2
    assert "\\midrule" in sinks.booktabs(df, "c", "l")


def test_public_names():
    import pulseloom

    assert all(callable(getattr(pulseloom, n)) for n in pulseloom.__all__ if n != "__version__")
    with pytest.raises(AttributeError):
        pulseloom.nothing
