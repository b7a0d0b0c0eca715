"""Exact deduplication of incoming documents against immutable snapshots.

A snapshot keeps its distinct digests in buckets, and for each bucket a static
binary-fuse filter, both as files that later batches read. Incoming digests are first grouped among themselves, then
screened by the filter of their bucket: a no is final, a yes is joined with the
exact bucket. Every digest that more than one row has is then checked byte for
byte. Only digests move between tasks; texts move for the byte check alone.

Defined cases: a null text equals an empty one; the row with the largest
doc_id stays, a null doc_id counts as smaller than any other; of rows with the
same doc_id and text one stays; an empty table gives an empty result; further
columns are ignored by ``groups_of`` and kept by ``keep``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import BROADCAST_ROWS, attach, materialize, shared_dir, text_or_empty
from pulseloom.llm.fuse import FuseFilter

#: Digests a bucket is to hold; the number of buckets follows the input.
BUCKET_KEYS = 4096
MIN_BUCKETS = 64


def digest_of(text="text"):
    return F.unhex(F.sha2(text_or_empty(text), 256))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(_keys(pdf["digest"]))
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.cells.tobytes()]})


def build_filters(distinct: DataFrame, buckets: int) -> DataFrame:
    """One static filter per bucket of a snapshot's distinct digests."""
    keyed = distinct.select(_bucket(buckets), "digest")
    return keyed.groupBy("bucket").applyInPandas(_build, "bucket int, seed long, segment int, segments int, cells binary")


def _probe(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(incoming), bool)
    if len(incoming) and len(filters):
        x = filters.iloc[0]
        f = FuseFilter(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["cells"], np.uint16))
        hit = f.contains(_keys(incoming["digest"]))
    return incoming.drop(columns="bucket").assign(hit=hit)


def screen(distinct: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """distinct (digest, keep_id, n) with hit: whether the snapshot's filter lets the digest through."""
    left = distinct.select(_bucket(buckets), "digest", "keep_id", "n")
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_probe, "digest binary, keep_id long, n long, hit boolean")


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("n"))


def write_snapshot(distinct: DataFrame, path: str) -> None:
    """Keep a snapshot's groups (digest, keep_id, n), and the filters of their buckets, as files that don't change."""
    distinct.write.parquet(f"{path}/digests")
    kept = distinct.sparkSession.read.schema(distinct.schema).parquet(f"{path}/digests")
    buckets = max(MIN_BUCKETS, -(-kept.count() // BUCKET_KEYS))
    build_filters(kept, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def merge(path: str, incoming: DataFrame) -> DataFrame:
    """Groups (digest, keep_id, n) of the snapshot in a path and of a batch's groups, by way of the snapshot's filters."""
    spark = incoming.sparkSession
    snapshot, filters = spark.read.schema(incoming.schema).parquet(f"{path}/digests"), spark.read.parquet(f"{path}/filters")
    row = filters.select("buckets").first()
    screened = materialize(screen(incoming, filters.drop("buckets"), row["buckets"] if row else MIN_BUCKETS), "screened")
    maybe = screened.filter("hit").select("digest", F.col("keep_id").alias("_id"), F.col("n").alias("_n"))
    exact = snapshot.join(maybe, "digest", "full").select(
        "digest", F.greatest("keep_id", "_id").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")
    )
    return exact.unionByName(screened.filter("NOT hit").drop("hit"))


def _unequal(docs: DataFrame, groups: DataFrame, text: str) -> DataFrame:
    """Digests whose rows differ in their bytes: their smallest and largest text are not the same."""
    texts = docs.select(digest_of(text).alias("digest"), text_or_empty(text).alias("_text"))
    several = groups.filter("n > 1").select("digest")
    texts = texts.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "digest", "left_semi")
    return texts.groupBy("digest").agg(F.min("_text").alias("low"), F.max("_text").alias("high")).filter("low <> high").select("digest")


def groups_of(docs: DataFrame, text: str = "text", key: str = "doc_id", in_snapshot=None) -> DataFrame:
    """A row for each distinct text: digest, keep_id, n.

    in_snapshot: boolean column that tells which rows are an earlier, immutable
    snapshot; by default a fixed half of the rows by hash of their key.
    """
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    rows = docs.select(F.col(key).alias("doc_id"), digest_of(text).alias("digest"), in_snapshot.alias("old"))
    rows = materialize(rows.groupBy("doc_id", "digest", "old").agg(F.count("*").alias("copies")), "digests")
    path = f"{shared_dir(docs.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(_distinct(rows.filter("old")), path)
    incoming = materialize(_distinct(rows.filter("NOT old")), "incoming")
    groups = materialize(merge(path, incoming), "groups")
    clash = _unequal(docs, groups, text).count()
    if clash:
        raise ValueError(f"{clash} SHA-256 digests belong to texts that differ")
    return groups, rows.groupBy("doc_id", "digest").agg(F.sum("copies").alias("copies"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", in_snapshot=None) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups, rows = groups_of(docs, text, key, in_snapshot)
    several = groups.filter("n > 1")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    out = attach(rows, several, "digest", "n", total)
    out = out.withColumn("keep_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        "doc_id",
        "keep_id",
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("_copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with the columns of docs; texts of single documents never shuffle."""
    groups, rows = groups_of(docs, text, key)
    total = rows.agg(F.sum("copies")).first()[0] or 0
    several = groups.filter("n > 1")
    members = attach(rows, several, "digest", "n", total, "inner").filter("doc_id <=> keep_id")
    several = materialize(members.select("digest", "keep_id", "n", "copies"), "several")
    packed = docs.select(digest_of(text).alias("digest"), F.struct(*docs.columns).alias("row"))
    marked = attach(packed, several, "digest", "n", total)
    marked = marked.filter(F.col("n").isNull() | F.col(f"row.{key}").eqNullSafe(F.col("keep_id")))
    repeated = F.coalesce("copies", F.lit(1)) > 1
    return marked.filter(~repeated).unionByName(marked.filter(repeated).dropDuplicates(["digest"])).select("row.*")
