"""Tests by ranks: of all pairs of groups, and of two samples, without a group or a pair in one task.

Rows are first counted by group and value. Ranges of values, each in order in
one task, hold the counts of all groups. Within a range the running counts of
all groups are compared at once, as a product of matrices; between ranges it is
enough to know how many rows of each group a range has. So no row is copied for
another group, and a group of all rows spreads over all ranges.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulseloom.functions.special import normal_cdf
from pulseloom.sources.sinks import working_dir

#: Pairs with a group of at most so many rows, without ties and with a product of rows up to EXACT_PRODUCT have exact p-values.
EXACT_ROWS, EXACT_PRODUCT = 8, 1 << 14
#: Numbers of a matrix of values and groups at once; cells by which groups meet.
NUMBERS, CELLS = 1 << 20, 8


def _kept(df: DataFrame) -> DataFrame:
    """df written once and read back: ranges are drawn anew each time that they are computed."""
    path = working_dir(df.sparkSession)
    df.write.parquet(f"{path}/ranks")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/ranks")


class _Range:
    """Counts of all groups over the values of a range, in order."""

    def __init__(self):
        self.index: dict = {}
        self.seen, self.cubes = np.zeros(0), np.zeros(0)
        self.wins, self.cross = np.zeros((0, 0)), np.zeros((0, 0))

    def _grow(self, groups: list) -> None:
        for g in groups:
            self.index.setdefault(g, len(self.index))
        more = len(self.index) - len(self.seen)
        self.seen, self.cubes = np.pad(self.seen, (0, more)), np.pad(self.cubes, (0, more))
        self.wins, self.cross = np.pad(self.wins, (0, more)), np.pad(self.cross, (0, more))

    def add(self, groups: list, values: np.ndarray, counts: np.ndarray) -> None:
        """Rows of whole values."""
        self._grow(groups)
        column = np.array([self.index[g] for g in groups], np.int64)
        new = np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))
        row = np.cumsum(new) - 1
        step = max(1, NUMBERS // max(1, len(self.index)))
        for at in range(0, int(row[-1]) + 1 if len(row) else 0, step):
            part = slice(*np.searchsorted(row, (at, at + step)))
            n = np.zeros((min(step, int(row[-1]) + 1 - at), len(self.index)))
            n[row[part] - at, column[part]] = counts[part]
            before = self.seen + np.cumsum(n, 0) - n
            self.wins += n.T @ (before + n / 2)
            both = (n * n).T @ n
            self.cross += both + both.T
            self.cubes += (n * n * n - n).sum(0)
            self.seen += n.sum(0)


def _ranges(counts: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """counts (g, v, n) -> a row for each range and group (b is null: n, cubes), and for each range and pair that meet in it (wins, cross)."""
    schema = f"range int, a {kind}, b {kind}, pair boolean, n double, cubes double, wins double, cross double"

    def of(batches):
        held, sums = [], _Range()
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            v = table["v"].to_numpy()
            whole = int(np.searchsorted(v, v[-1])) if len(v) else 0
            if whole:
                sums.add(table["g"].slice(0, whole).to_pylist(), v[:whole], table["n"].to_numpy()[:whole])
            held = table.slice(whole).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            sums.add(table["g"].to_pylist(), table["v"].to_numpy(), table["n"].to_numpy())
        names, number = list(sums.index), TaskContext.get().partitionId()
        for i, name in enumerate(names):
            others = [j for j in range(len(names)) if j != i]
            a, b = [name] * (1 + len(others)), [None, *(names[j] for j in others)]
            blank = [0.0] * len(others)
            columns = [[sums.seen[i], *blank], [sums.cubes[i], *blank], [0.0, *sums.wins[i, others]], [0.0, *sums.cross[i, others]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(a), pa.int32()), pa.array(a, arrow), pa.array(b, arrow), pa.array([False] + [True] * len(others)), *(pa.array(c, pa.float64()) for c in columns)],
                ["range", "a", "b", "pair", "n", "cubes", "wins", "cross"],
            )

    dealt = counts.repartitionByRange("v").sortWithinPartitions("v")
    return _kept(dealt.mapInArrow(of, schema))


@lru_cache(maxsize=256)
def exact_tail(n1: int, n2: int) -> tuple[float, ...]:
    """P(U >= u) for u = 0 ... n1 n2 of tie-free samples, from the counts of orders by their rank sum (products of q-binomials)."""
    size = n1 * n2 + 1
    ways = [1] + [0] * (size - 1)
    for i in range(1, min(n1, n2) + 1):
        up = max(n1, n2) + i
        for k in range(size - 1, up - 1, -1):
            ways[k] -= ways[k - up]
        for k in range(i, size):
            ways[k] += ways[k - i]
    total, tail, out = math.comb(n1 + n2, n1), 0, []
    for k in range(size - 1, -1, -1):
        tail += ways[k]
        out.append(tail / total)
    return tuple(out[::-1])


def mann_whitney(values: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Two-sided tests of all pairs of groups, with their rank-biserial correlation; Bonferroni over the pairs.

    p-values are exact for small pairs without ties (see EXACT_ROWS), else of the
    normal approximation with ties and continuity. Null groups belong to no pair,
    null and NaN values don't count.
    """
    kind, arrow = values.schema[group].dataType.simpleString(), to_arrow_type(values.schema[group].dataType)
    rows = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    found = _ranges(rows.groupBy("g", "v").agg(F.count("*").cast("double").alias("n")), kind, arrow)
    met = found.filter("pair AND a < b").groupBy("a", "b").agg(F.sum("wins").alias("wins"), F.sum("cross").alias("cross"))
    # Of each group its rows range by range; ranges are as many as tasks.
    vectors = found.filter("NOT pair").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("range", "n"))).alias("own"), F.sum("n").alias("n"), F.sum("cubes").alias("cubes"))
    cell = F.pmod(F.xxhash64("a"), F.lit(CELLS)).cast("int")
    side = lambda p: vectors.select(*[F.col(c).alias(f"{p}_{c}") for c in vectors.columns], cell.alias(f"{p}_cell"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    left, right = side("l").withColumn("r_cell", cells), side("r").withColumn("l_cell", cells)
    pairs = left.join(right, ["l_cell", "r_cell"]).filter("l_a < r_a")

    @F.pandas_udf("double")
    def ahead(own: pd.Series, other: pd.Series) -> pd.Series:
        """Pairs of rows of which the first's range is behind the other's."""
        out = []
        for x, y in zip(own, other):
            at, n = np.array([e["range"] for e in x]), np.array([e["n"] for e in x])
            to, m = np.array([e["range"] for e in y]), np.cumsum([0.0, *(e["n"] for e in y)])
            out.append(float(n @ m[np.searchsorted(to, at, side="left")]))
        return pd.Series(out)

    @F.pandas_udf("double")
    def p_value(n1: pd.Series, n2: pd.Series, u: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for a, b, x, score, t in zip(n1, n2, u, z, ties):
            if t == 0 and min(a, b) <= EXACT_ROWS and a * b <= EXACT_PRODUCT:
                out.append(min(1.0, 2 * exact_tail(int(a), int(b))[int(round(max(x, a * b - x)))]))
            else:
                out.append(min(1.0, 2 * (1 - normal_cdf(score))))
        return pd.Series(out)

    m = pairs.select(F.col("l_a").alias("a"), F.col("r_a").alias("b"), F.col("l_n").alias("n1"), F.col("r_n").alias("n2"), (F.col("l_cubes") + F.col("r_cubes")).alias("cubes"), ahead("l_own", "r_own").alias("ahead"))
    m = m.join(met, ["a", "b"], "left")
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    m = m.withColumns({"u": F.col("ahead") + F.coalesce("wins", F.lit(0.0)), "ties": F.col("cubes") + 3 * F.coalesce("cross", F.lit(0.0))})
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5, F.lit(0.0)), F.nullif(sigma, F.lit(0.0)))
    m = m.withColumns({"z": F.coalesce(z, F.lit(0.0)), "rank_biserial": 1 - 2 * F.col("u") / (n1 * n2)})
    m = m.withColumn("p_value", p_value("n1", "n2", "u", "z", "ties")).crossJoin(F.broadcast(vectors.agg((F.count("*") * (F.count("*") - 1) / 2).alias("tests"))))
    out = m.withColumn("significant", F.col("p_value") < alpha / F.col("tests"))
    return out.select("a", "b", n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), "u", "z", "rank_biserial", "p_value", "significant")


def kolmogorov_p(distance: Column, n1: Column, n2: Column, terms: int = 50) -> Column:
    """Asymptotic p-value of a distance of two samples, with Stephens' correction, by its series; 1 below a distance that any two samples have."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    x = (root + 0.12 + 0.11 / root) * distance
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def two_sample_ks(values: DataFrame, value: str, first: Column, by: str = "series_id", alpha: float = 0.05) -> DataFrame:
    """Largest distance of the distributions of rows where ``first`` holds and of the others, for each ``by``; both need a row.

    Null and NaN values don't count; a null condition is not the first sample.
    """
    first = F.coalesce(first, F.lit(False))
    rows = values.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"), first.cast("long").alias("_f")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    counts = rows.groupBy("_by", "_v").agg(F.sum("_f").alias("_x"), F.sum(1 - F.col("_f")).alias("_y"))
    dealt = _kept(counts.repartitionByRange("_by", "_v").withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("_by", "_range").agg(F.sum("_x").alias("_sx"), F.sum("_y").alias("_sy"))
    over = Window.partitionBy("_by").orderBy("_range")
    whole = Window.partitionBy("_by")
    parts = parts.select(
        F.col("_by").alias("_of"), F.col("_range").alias("_at"), (F.sum("_sx").over(over) - F.col("_sx")).alias("_bx"), (F.sum("_sy").over(over) - F.col("_sy")).alias("_by_y"),
        F.sum("_sx").over(whole).alias("n1"), F.sum("_sy").over(whole).alias("n2"),
    )
    to_here = Window.partitionBy("_by", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({"_cx": F.sum("_x").over(to_here), "_cy": F.sum("_y").over(to_here)})
    rows = rows.join(parts.filter("n1 > 0 AND n2 > 0"), F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    gap = F.abs((F.col("_cx") + F.col("_bx")) / F.col("n1") - (F.col("_cy") + F.col("_by_y")) / F.col("n2"))
    m = rows.groupBy("_by").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("distance"))
    m = m.withColumn("p_value", kolmogorov_p(F.col("distance"), F.col("n1"), F.col("n2")))
    return m.select(F.col("_by").alias(by), "n1", "n2", "distance", "p_value", (F.col("p_value") < alpha).alias("differ"))
