"""Writers of results: tables through Spark, small reports as text."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Rows that a text report may hold.
REPORT_ROWS = 10_000


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """A small table as one file with a byte-order mark, for spreadsheets."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(["" if v is None else v for v in r] for r in _rows(df))


def export_parquet(df: DataFrame, directory: str, prefix: str) -> str:
    """Write a table under a time-stamped name, as CSV where a type doesn't go into Parquet; returns its path."""
    path = f"{directory}/{prefix}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    try:
        write_parquet(df, f"{path}.parquet")
        return f"{path}.parquet"
    except AnalysisException:
        write_csv(df, f"{path}.csv")
        return f"{path}.csv"


def write_text(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def write_metrics(directory: str, metrics: dict, intervals: DataFrame) -> None:
    """metrics.json, and the intervals as a table beside it."""
    write_text(f"{directory}/metrics.json", json.dumps(metrics, indent=2, default=str))
    write_csv(intervals, f"{directory}/intervals", single=True)


def write_signals(path: str, clean, noisy, fs: float) -> None:
    """A clean and a noisy signal and their rate as a numpy archive."""
    import numpy as np

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    np.savez(path, clean=clean, noisy=noisy, fs=fs)


def working_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a temporary one where that is unset in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="pulseloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def write_manifest(path: str, config: dict, counts: dict) -> None:
    record = {"timestamp": datetime.now(timezone.utc).isoformat(), "config": config, **counts}
    write_text(path, json.dumps(record, indent=2, default=str))


def _rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds {REPORT_ROWS} rows at most; write a table instead")
    return rows


def _cell(value, digits: int) -> str:
    return "" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def latex_table(df: DataFrame, caption: str, label: str, digits: int = 4) -> str:
    head = " & ".join(c.replace("_", r"\_") for c in df.columns)
    body = "\n".join(" & ".join(_cell(v, digits).replace("_", r"\_") for v in r) + r" \\" for r in _rows(df))
    columns = "l" * len(df.columns)
    return f"\\begin{{table}}[htbp]\n\\centering\n\\caption{{{caption}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{columns}}}\n\\hline\n{head} \\\\\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n\\end{{table}}\n"


def booktabs(df: DataFrame, caption: str, label: str, digits: int = 4) -> str:
    """The same with rules of the booktabs package."""
    plain = latex_table(df, caption, label, digits)
    for rule in ("toprule", "midrule", "bottomrule"):
        plain = plain.replace("\\hline", f"\\{rule}", 1)
    return plain


def text_table(df: DataFrame, title: str, digits: int = 4) -> str:
    rows = [[_cell(v, digits) for v in r] for r in _rows(df)]
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([title, "=" * len(title), line(df.columns), line(["-" * w for w in widths]), *map(line, rows), ""])
