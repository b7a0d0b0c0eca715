"""The driver's tables as the library's objects: pulse streams, sampled waveforms, array segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task gets when a large table is dealt by key.
ROWS = 250_000


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """In how many parts a table is dealt by key: the session's, or more, so that a task's rows don't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, sf_dir, name).count() // ROWS))


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows by key in n parts, where these are more than the session's; else as they are, for Spark to deal."""
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as pulses: series_id (user), k (from 0), event_id, channel, toa_s, peak_v."""
    w = Window.partitionBy("series_id").orderBy("toa_s", "event_id")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1e6D")
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), "event_id", F.col("event_type").alias("channel"), seconds.alias("toa_s"), F.col("value").alias("peak_v")
    )
    return dealt(e, parts(spark, sf_dir, "events"), "series_id").withColumn("k", (F.row_number().over(w) - 1).cast("long"))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one sampled waveform for each supplier: series_id, idx (from 0), x."""
    w = Window.partitionBy("series_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    x = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"))
    return dealt(x, parts(spark, sf_dir, "lineitem"), "series_id").select("series_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "x")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as array waveforms: series_id, label, samples array<double>."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), "label", F.col("embedding").cast("array<double>").alias("samples"))


#: The same objects in DuckDB SQL, as common table expressions.
PULSES_SQL = """pulses AS (SELECT user_id AS series_id, event_id, event_type AS channel, epoch_us(ts) / 1e6 AS toa_s, value AS peak_v,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)"""
INTERVALS_SQL = (
    PULSES_SQL
    + """, intervals AS (SELECT series_id, k - 1 AS k, event_id, channel, toa_s, delta_t_s, peak_v FROM (SELECT *, toa_s - lag(toa_s) OVER (PARTITION BY series_id ORDER BY k) AS delta_t_s FROM pulses) WHERE k > 0)"""
)
WAVEFORMS_SQL = """waves AS (SELECT l_suppkey AS series_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS idx,
 l_extendedprice AS x FROM lineitem)"""
