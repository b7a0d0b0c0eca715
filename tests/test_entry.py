"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_streams_carry_state_over_batches(spark, tmp_path):
    from pulseloom.operators import intervals
    from pulseloom.sources.tables import pulses
    from pulseloom.streaming import tracking

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    edges = table.approxQuantile("event_id", [0.33, 0.66], 0)
    for i, part in enumerate((table.filter(table.event_id <= edges[0]), table.filter((table.event_id > edges[0]) & (table.event_id <= edges[1])), table.filter(table.event_id > edges[1]))):
        part.coalesce(1).sortWithinPartitions("ts").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"events.parquet_{i}", index=False)
    out = tracking.replay(spark, str(tmp_path), tracking.delta_t)
    batch = intervals.delta_t(pulses(spark, "/root/testdata/sf0.001"))
    assert out.count() == batch.count()
    assert abs(out.agg({"delta_t_s": "sum"}).first()[0] - batch.agg({"delta_t_s": "sum"}).first()[0]) < 1e-3
