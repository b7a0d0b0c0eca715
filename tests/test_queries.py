"""Every query with a SQL twin against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from pulseloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(value):
    return ("%.6g" % value if math.isfinite(value) else str(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    expected = tables.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["threshold_peaks", "pulse_windows", "dead_time", "phase_outliers", "descriptors12"])
def test_larger_tables_are_dealt_in_more_parts(spark, tables, monkeypatch, name):
    """A task's rows don't grow with the table, and results stay those of the SQL."""
    from pulseloom.sources import tables as sources

    monkeypatch.setattr(sources, "ROWS", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        least = -(-sources.read(spark, SF, "events" if name.startswith("phase") else "lineitem").count() // 100)
        # The windows of pulses are counted at last, from partial counts.
        if name != "pulse_windows":
            assert catalog.queries()[name](spark, SF).rdd.getNumPartitions() >= min(least, 10) > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    test_matches_sql(spark, tables, name)
