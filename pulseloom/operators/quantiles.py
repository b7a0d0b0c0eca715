"""Exact quantiles of groups by refinement, so that no task holds a large group's values.

A wanted rank of a large group lies in an open range of values, at first all of
them. In each pass a mergeable sketch of the range gives two values close to
both sides of the rank, and exact counts tell on which side of them, or on
which of them, it falls. Each pass leaves out the two values at least and all
but some thousandths of the range as a rule, whatever the distribution; a range
of a bounded number of rows is put in order at last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.sources.sinks import working_dir

#: Rows of a group, or of a range, that one task puts in order.
ROWS = 100_000
#: Relative accuracy of a sketch is 1 / ACCURACY; ranges to look for are sent to all tasks up to a number of TARGETS.
ACCURACY, TARGETS = 2_000, 100_000


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{working_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(values: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Rows of values (g, v) with each target (g, rank, low, high, at, n) whose open range holds them."""
    side = F.broadcast(targets) if few else targets
    met = values.join(side, values["g"].eqNullSafe(targets["g"])).drop(targets["g"])
    return met.filter((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high"))))


def _refined(values: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Targets with a smaller range, or with the value itself."""
    share = (F.col("at") + 0.5) / F.col("n")
    margin = 2.0 / ACCURACY
    sides = F.array(F.greatest(F.lit(0.0), share - margin), F.least(F.lit(1.0), share + margin))
    # A sketch takes constant shares only: it gives all of them, from which the two are picked.
    steps = [i / ACCURACY for i in range(ACCURACY + 1)]
    sketch = _within(values, targets, few).groupBy("g", "rank").agg(F.percentile_approx("v", steps, 4 * ACCURACY).alias("_cuts"), F.first("at").alias("at"), F.first("n").alias("n"))
    place = lambda i: F.element_at("_cuts", (F.round(sides[i] * ACCURACY) + 1).cast("int"))
    cuts = written(sketch.select("g", "rank", place(0).alias("_a"), place(1).alias("_b")), "cuts")
    same = (targets["rank"] == cuts["rank"]) & targets["g"].eqNullSafe(cuts["g"])
    cut = targets.join(cuts, same).drop(cuts["g"]).drop(cuts["rank"])
    v, a, b = F.col("v"), F.col("_a"), F.col("_b")
    counts = _within(values, cut, few).groupBy("g", "rank", "low", "high", "at", "n", "_a", "_b").agg(
        F.count_if(v < a).alias("_below"), F.count_if(v == a).alias("_on_a"), F.count_if((v > a) & (v < b)).alias("_mid"), F.count_if((v == b) & (b > a)).alias("_on_b")
    )
    at, ends = F.col("at"), []
    for name in ("_below", "_on_a", "_mid", "_on_b"):
        ends.append(F.col(name) if not ends else ends[-1] + F.col(name))
    piece = lambda low, high, before, n, found: F.struct(low.alias("low"), high.alias("high"), (at - before).alias("at"), n.alias("n"), found.alias("found"))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    chosen = (
        F.when(at < ends[0], piece(F.col("low"), a, zero, F.col("_below"), none))
        .when(at < ends[1], piece(a, a, ends[0], F.col("_on_a"), a))
        .when(at < ends[2], piece(a, b, ends[1], F.col("_mid"), none))
        .when(at < ends[3], piece(b, b, ends[2], F.col("_on_b"), b))
        .otherwise(piece(b, F.col("high"), ends[3], F.col("n") - ends[3], none))
    )
    return counts.select("g", "rank", chosen.alias("_p")).select("g", "rank", "_p.*")


def at_ranks(values: DataFrame, targets: DataFrame) -> DataFrame:
    """g, rank, v of targets (g, rank), ranks from 0 and the size n of their groups."""
    open_ = written(targets.select("g", "rank", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("rank").alias("at"), "n"), "targets")
    done: list[DataFrame] = []
    while True:
        left, wide = open_.agg(F.count("*"), F.max("n")).first()
        if not left or wide <= ROWS:
            break
        few = left <= TARGETS
        stay = open_.filter(F.col("n") <= ROWS)
        pieces = written(_refined(values, open_.filter(F.col("n") > ROWS), few), "pieces")
        done.append(pieces.filter("found IS NOT NULL").select("g", "rank", F.col("found").alias("v")))
        open_ = written(stay.unionByName(pieces.filter("found IS NULL").drop("found")), "targets")
    if left:
        counts = _within(values, open_, left <= TARGETS).groupBy("g", "rank", "at", "v").agg(F.count("*").alias("m"))
        over = Window.partitionBy("g", "rank").orderBy("v")
        ranked = counts.withColumn("_end", F.sum("m").over(over))
        done.append(ranked.filter("at < _end AND at >= _end - m").select("g", "rank", "v"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def group_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, interpolated between neighbouring ranks as ``percentile`` does: the group, and a column for each share.

    Nulls and NaNs are no values; a group without a value has no row, a null
    group is one of its own. Groups of at most ROWS rows are put in order by a
    task each; larger ones are refined, in passes over their rows alone.
    df is read several times: give a table, not a costly plan.
    """
    values = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = written(values.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    large = sizes.filter(F.col("n") > ROWS)
    n_large = large.count()
    names = list(shares)
    if not n_large:
        return values.groupBy(F.col("g").alias(group)).agg(*[F.percentile("v", F.lit(shares[c])).alias(c) for c in names])
    match = values["g"].eqNullSafe(large["g"])
    marked = F.broadcast(large) if n_large <= TARGETS else large
    small = values.join(marked, match, "left_anti").groupBy("g").agg(*[F.percentile("v", F.lit(shares[c])).alias(c) for c in names])
    spots = large.select("g", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.lit(shares[c]) * (F.col("n") - 1)).alias("spot")) for c in names])).alias("s")).select("g", "n", "s.*")
    spots = spots.withColumns({"lo": F.floor("spot"), "hi": F.ceil("spot")})
    ranks = spots.select("g", "n", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    found = written(at_ranks(values.join(marked, match, "left_semi"), ranks), "found")
    pick = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))
    met = spots.join(pick, spots["g"].eqNullSafe(pick["g"])).drop(pick["g"])
    lo, hi = F.element_at("_at", F.col("lo")), F.element_at("_at", F.col("hi"))
    mixed = F.when(F.col("lo") == F.col("hi"), lo).otherwise((F.col("hi") - F.col("spot")) * lo + (F.col("spot") - F.col("lo")) * hi)
    wide = met.groupBy("g").agg(*[F.max(F.when(F.col("name") == c, mixed)).alias(c) for c in names])
    return small.unionByName(wide).withColumnRenamed("g", group)
