"""The waveform data source against the reader of whole files, by ranges of bytes and as a stream."""

import os
import random
import time

import numpy as np
import pytest

from pulseloom.sources import waveform_files, waveform_source


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    waveform_source.register(spark)


def text(r, n, columns=2, ends="\n"):
    head = ["Model,X", "Date:,19 NOV 2025", "Time:,14:23:42", ""]
    lines = [f"{i * 1e-6:.7f},{r.gauss(0, 1):.{r.randint(1, 9)}f}" if columns == 2 else f"{r.gauss(0, 1):.5f}" for i in range(n)]
    return ends.join(head + lines) + (ends if r.random() < 0.5 else "")


@pytest.fixture
def folder(tmp_path):
    r = random.Random(3)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text(text(r, 3000))
    (tmp_path / "two.csv").write_text(text(r, 500, 1))
    (tmp_path / "three.csv").write_bytes(text(r, 700, 2, "\r\n").encode())
    (tmp_path / "other.txt").write_text("1,2")
    return tmp_path


def test_files_are_those_of_load(spark, folder):
    (folder / "cell.csv").write_text("1,2\n" + "x" * 200_000 + ",3\n")
    (folder / "broken.h5").write_bytes(b"\x89HDF\r\n\x1a\nnothing")
    (folder / "broken.mat").write_bytes(b"nothing")
    (folder / "empty.csv").write_text("")
    got = {os.path.basename(r["path"]): r for r in spark.read.format("waveform").option("fs", 5e9).load(str(folder)).collect()}
    want = {r["file_name"]: r for r in waveform_files.load(spark, str(folder), 5e9).collect() if not r["file_name"].endswith(".txt")}
    # Spark's reader of whole files has no row for an empty one.
    assert got.pop("empty.csv")["error"].startswith("ValueError")
    assert set(got) == set(want) == {"one.csv", "two.csv", "three.csv", "cell.csv", "broken.h5", "broken.mat"}
    for name, x in want.items():
        assert (got[name]["fs_hz"], got[name]["trigger_epoch"], got[name]["error"]) == (x["fs_hz"], x["trigger_epoch"], x["error"])
        assert got[name]["samples"] == x["samples"] and got[name]["times"] == x["times"]
    assert all(want[n]["error"] and want[n]["samples"] is None for n in ("cell.csv", "broken.h5", "broken.mat"))


def small(folder):
    (folder / "small").mkdir()
    (folder / "small" / "two.csv").write_text("\n".join((folder / "two.csv").read_text().split("\n")[:60]))
    (folder / "two.csv").unlink()
    return folder / "small"


@pytest.mark.parametrize("split", [1 << 20, 1000, 7])
def test_ranges_of_bytes_give_every_line_once(spark, folder, split):
    # With 7 bytes a range may hold no line's beginning.
    df = spark.read.format("waveform").option("layout", "samples").option("split", split).option("pattern", "two.csv" if split == 7 else "*").load(str(folder if split > 7 else small(folder)))
    if split == 1000:
        assert df.rdd.getNumPartitions() > 60
    rows = waveform_source.numbered(df).select("path", "idx", "time", "value").collect()
    want = {r["path"].split("/")[-1]: r for r in waveform_files.load(spark, str(folder), 1.0, preserve_amplitude=True).filter("error IS NULL").collect()}
    names = {r["path"].split("/")[-1] for r in rows}
    assert names == ({"one.csv", "two.csv", "three.csv"} if split > 7 else {"two.csv"})
    for name in names:
        mine = sorted((r["idx"], r["value"], r["time"]) for r in rows if r["path"].endswith(name))
        assert [i for i, _, _ in mine] == list(range(len(want[name]["samples"])))
        values = np.array([v for _, v, _ in mine])
        assert np.allclose(values - values.mean(), want[name]["samples"])
        if name != "two.csv":
            assert np.allclose([t for _, _, t in mine], want[name]["times"])


def test_pruned_and_empty(spark, folder, tmp_path_factory):
    df = spark.read.format("waveform").option("pattern", "t*.csv").option("recursive", "false").load(str(folder))
    assert df.count() == 2
    assert spark.read.format("waveform").load(str(tmp_path_factory.mktemp("none"))).count() == 0
    (folder / "wide.csv").write_text("1,2,3\n4,5,6\n")
    bad = spark.read.format("waveform").option("layout", "samples").option("pattern", "wide.csv").load(str(folder)).collect()
    assert len(bad) == 1 and bad[0]["error"].startswith("ValueError")


def test_new_files_are_streamed(spark, folder, tmp_path):
    def run():
        q = spark.readStream.format("waveform").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return sorted(r["file_name"] for r in spark.read.parquet(str(tmp_path / "out")).select("file_name").collect())

    assert run() == ["one.csv", "three.csv", "two.csv"]
    time.sleep(0.05)
    (folder / "new.csv").write_text("1\n2\n3\n")
    assert run() == ["new.csv", "one.csv", "three.csv", "two.csv"]
    assert run() == ["new.csv", "one.csv", "three.csv", "two.csv"]
