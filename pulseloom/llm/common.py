"""Helpers that the corpus operators share: materialising, size-checked joins, texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters one by one, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast up to this many rows of narrow keys (some 20 MB); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: A key with more than this share of all rows is hot; there are at most HOT_SHARE such keys, whatever the input's size.
HOT_SHARE = 1000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dirs[key] = tempfile.mkdtemp(prefix="pulseloom-")
        atexit.register(shutil.rmtree, _own_dirs[key], ignore_errors=True)
    return f"file://{_own_dirs[key]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and give it to body; a lambda would evaluate it again for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The array of words of a text."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def count_words(text: Column) -> Column:
    """Number of words, without building them: each run of word characters becomes one character."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACE_CHARS, "")).cast("long")


def own_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def attach(rows: DataFrame, info: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with info, which has one row for each key and in ``count`` how many rows have that key.

    info is broadcast while it is small. Beyond that, hot keys (over total /
    HOT_SHARE rows each, so HOT_SHARE keys at most) still go by broadcast and
    only the other rows shuffle, so that no key fills a task.
    """
    if info.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(info), key, how)
    limit = max(1, total // HOT_SHARE)
    hot = info.filter(F.col(count) > limit)
    mark = own_name(rows, "_hot")
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    cold_rows = marked.filter(F.col(mark).isNull()).drop(mark)
    hot_rows = marked.filter(F.col(mark).isNotNull()).drop(mark)
    return cold_rows.join(info.filter(F.col(count) <= limit), key, how).unionByName(hot_rows.join(F.broadcast(hot), key, how))


#: Rows that a cell of the numbering is to hold, and cells at least.
CELL_ROWS, MIN_CELLS = 4096, 512


def numbered(rows: DataFrame, group: str, order: list[str], n: int, name: str) -> DataFrame:
    """rows with their number within their group, from 0: within cells of a bounded size, plus the rows of the cells before.

    A group may hold any share of the n rows: its rows are dealt over all cells by a hash of ``order``.
    """
    cells = max(MIN_CELLS, n // CELL_ROWS)
    placed = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = placed.groupBy(group, "_cell").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, "_cell").orderBy(*order)
    out = placed.withColumn("_in_cell", F.row_number().over(within) - 1).join(counts, [group, "_cell"])
    return out.withColumn(name, (F.col("_offset") + F.col("_in_cell")).cast("long")).drop("_cell", "_in_cell", "_offset")


def distinct_texts(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, copies), narrow and written, and content (node, text) with one row for each distinct text.

    node is the first half of the text's SHA-256. Only texts that occur more
    than once are looked up, so that texts never shuffle.
    """
    node = F.substring(F.unhex(F.sha2(text_or_empty(text), 256)), 1, 16)
    rows = docs.select(F.col(key).alias("doc_id"), node.alias("node")).groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "nodes")
    several = materialize(rows.groupBy("node").agg(F.sum("copies").alias("n"), F.max("doc_id").alias("keep_id")).filter("n > 1"), "several")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    chosen = attach(rows, several, "node", "n", total, "inner").filter("doc_id <=> keep_id")
    chosen = materialize(chosen.select("node", "keep_id", "n", "copies"), "chosen")
    all_ = attach(docs.select(node.alias("node"), F.col(key).alias("doc_id"), text_or_empty(text).alias("text")), chosen, "node", "n", total)
    all_ = all_.filter("n IS NULL OR doc_id <=> keep_id")
    repeated = F.coalesce("copies", F.lit(1)) > 1
    return rows, all_.filter(~repeated).select("node", "text").unionByName(all_.filter(repeated).select("node", "text").dropDuplicates(["node"]))


def first_by(docs: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows that come first by a hash (more on ties). Only hashes are ordered; the rows themselves are then filtered."""
    hashes = docs.select(order.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return docs.limit(0) if hashes is None else docs.filter(order <= hashes)
