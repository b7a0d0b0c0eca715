"""Mix overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they
belong to. Token capacity flows from patterns to the sources' quotas; the e-th
pass over a pattern costs e, so that repetition is spread before it is
deepened. A pattern that is to give F words of N gives all its documents
F // N times, and once more a seeded selection for the rest: the first ones in the
seeded order that fit, then smaller later ones for what is still missing.

Defined cases: a null text has no words and is never taken; null sources are a
source of their own; rows with the same key and text are taken together; an
empty table gives an empty result; further columns are ignored by ``mix`` and
kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import BROADCAST_ROWS, count_words, materialize, text_or_empty
from pulseloom.llm.flow import Network

#: Buckets of the seeded order, at least; more where the rows are many.
MIN_BUCKETS, BUCKET_ROWS = 4096, 4096
#: Times that what is still missing is filled with later, smaller documents.
ROUNDS = 4

Targets = Callable[[dict], dict]


def weighted_targets(weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), ceiling: int = 2) -> Targets:
    """Targets of sources in code point order, null last: they weigh ``weights``, repeating, and share ``share`` of all
    sizes. None gets more than ``ceiling`` times its size; what is above goes to the others by weight."""

    def targets(sizes: dict) -> dict:
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
        left, open_, found = share * sum(sizes.values()), list(order), {}
        while open_:
            total = sum(weight[s] for s in open_)
            over = [s for s in open_ if left * weight[s] / total > ceiling * sizes[s]]
            if not over:
                return found | {s: left * weight[s] / total for s in open_}
            for s in over:
                found[s] = Fraction(ceiling * sizes[s])
            left -= sum(found[s] for s in over)
            open_ = [s for s in open_ if s not in found]
        return found

    return targets


def route(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources; patterns: their words, quotas: words for each source.

    A source that shares no document with another one has a single path, whose
    flow is the smaller of its ends; only overlapping sources need the network.
    """
    shared = {s for key in patterns if len(key) != 1 for s in key}
    alone = {key: {key[0]: min(repeats * n, quotas[key[0]])} for key, n in patterns.items() if len(key) == 1 and key[0] not in shared}
    return alone | _network({key: n for key, n in patterns.items() if key not in alone}, {s: q for s, q in quotas.items() if s in shared}, repeats)


def _network(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, dict]:
    names, keys = list(quotas), list(patterns)
    if not keys:
        return {}
    index = {s: i for i, s in enumerate(names)}
    net = Network(len(keys) + len(names) + 2)
    start, end = len(keys) + len(names), len(keys) + len(names) + 1
    edges = []
    for p, key in enumerate(keys):
        for epoch in range(repeats):
            net.add(start, p, patterns[key], epoch)
        edges.append({s: net.add(p, len(keys) + index[s], repeats * patterns[key], 0) for s in key})
    for s in names:
        net.add(len(keys) + index[s], end, quotas[s], 0)
    net.solve(start, end)
    return {key: {s: net.flow(e) for s, e in edges[p].items()} for p, key in enumerate(keys)}


@dataclass(frozen=True)
class Mix:
    """A solved mix: sizes and targets of the sources, flows of the patterns, and for each document its passes."""

    sizes: dict
    targets: dict
    flows: dict
    decisions: DataFrame  # pattern, passes, steps: one more pass for documents of at most that size between two places


def _pattern(members: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(members)))


def _order(key: Column, text: Column, seed: int) -> Column:
    """Place of a document in the seeded order: 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 2)


def solve(rows: DataFrame, targets: Targets, repeats: int) -> Mix:
    """rows: members array<string>, pattern, size, order. The driver holds a number of words for each pattern, a set of sources, and for none of the documents."""
    spark = rows.sparkSession
    found = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    members = {r["pattern"]: tuple(dict.fromkeys(r["members"])) for r in found}
    words = {r["pattern"]: r["size"] for r in found}
    sizes: dict = {}
    for p, names in members.items():
        for s in names:
            sizes[s] = sizes.get(s, 0) + words[p]
    goal = targets(sizes)
    flows = {}
    if found:
        by_members: dict[tuple, int] = {members[p]: words[p] for p in members}
        flows = route(by_members, {s: round(goal[s]) for s in sizes}, repeats)
    plan = {p: divmod(sum(flows[members[p]].values()), words[p]) if words[p] else (0, 0) for p in members}
    rest, steps = {p: r for p, (_, r) in plan.items() if r}, {p: [] for p in members}
    missing, after, skipped = dict(rest), {p: -1 for p in rest}, {}
    for step in range(ROUNDS):
        if not missing:
            break
        limit = dict(missing) if step else {p: words[p] for p in missing}
        last, out = _prefix(rows, missing, after, limit, sum(r["n"] for r in found))
        for p, (to, size) in last.items():
            steps[p].append((after[p], to, limit[p]))
            rest[p] -= size
            after[p] = max(to, out[p][0] if p in out else -1)
            if not step and p in out:
                skipped[p] = out[p]
        missing = {p: rest[p] for p in last if rest[p] > 0}
    for p, (order, size) in skipped.items():
        if 2 * rest[p] > size:  # with the first document that didn't fit the sum comes nearer
            steps[p].append((order - 1, order, size))
    data = [(p, full, steps[p]) for p, (full, _) in plan.items()]
    decisions = _side(spark, data, "pattern string, passes long, steps array<struct<after:long,to:long,limit:long>>")
    return Mix(sizes, goal, flows, decisions)


def _side(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A row for each pattern, to be joined with documents: broadcast while it is small."""
    df = spark.createDataFrame(data, schema)
    return F.broadcast(df) if len(data) <= BROADCAST_ROWS else df


def _prefix(rows: DataFrame, rest: dict, after: dict, limit: dict, n: int) -> tuple[dict, dict]:
    """For each pattern the last place of its first ``rest`` words in the seeded order, and how many they are.

    Only documents after a place and of a limited size count. Sums of buckets of
    the order tell in which of them the words run out; only its rows are then
    put in order. Also returns place and size of the first document that doesn't fit.
    """
    spark = rows.sparkSession
    buckets = max(MIN_BUCKETS, n // BUCKET_ROWS)
    width = (1 << 62) // buckets
    wanted = _side(spark, [(p, r, after[p], limit[p]) for p, r in rest.items()], "pattern string, rest long, after long, limit long")
    placed = rows.join(wanted, "pattern").filter("order > after AND size <= limit AND size > 0")
    placed = placed.select("pattern", "rest", "size", "order", F.expr(f"order div {width}").alias("bucket"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("pattern", "rest", "bucket").agg(F.sum("size").alias("size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter("before < rest")
    edge = sums.groupBy("pattern").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("e")).select("pattern", "e.*").collect()
    if not edge:
        return {}, {}
    edges = _side(spark, [tuple(r) for r in edge], "pattern string, bucket long, before long")
    near = placed.join(edges, ["pattern", "bucket"]).groupBy("pattern", "before", "rest", "order").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("pattern").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    whole = F.col("ahead") + F.col("size") <= F.col("rest")
    chosen = near.groupBy("pattern").agg(
        F.max(F.when(whole, F.struct("order", (F.col("ahead") + F.col("size")).alias("sum")))).alias("in"), F.min(F.when(~whole, F.struct("order", "size"))).alias("out")
    )
    last, stop = {r["pattern"]: (r["bucket"] * width - 1, r["before"]) for r in edge}, {}
    for r in chosen.collect():  # a row for each pattern
        if r["in"] is not None:
            last[r["pattern"]] = (r["in"]["order"], r["in"]["sum"])
        if r["out"] is not None:
            stop[r["pattern"]] = (r["out"]["order"], r["out"]["size"])
    return last, stop


def _rows(docs: DataFrame, text: str, key: str, members: Column, seed: int) -> DataFrame:
    t = text_or_empty(text)
    return docs.select(
        F.col(key).alias("doc_id"), members.alias("members"), _pattern(members).alias("pattern"), count_words(t).alias("size"), _order(F.col(key), t, seed).alias("order")
    )


def _taken(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows with passes: how often the mix takes the document."""
    out = rows.join(mix.decisions, "pattern", "left")
    order, size = F.col("order"), F.col("size")
    more = F.exists("steps", lambda s: (order > s["after"]) & (order <= s["to"]) & (size <= s["limit"]))
    return out.withColumn("passes", F.col("passes") + more.cast("long"))


def mix(docs: DataFrame, targets: Targets | None = None, text: str = "text", key: str = "doc_id", members: Column | None = None, seed: int = 7, repeats: int = 2) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken; with several sources, the first one's."""
    members = F.array("source") if members is None else members
    rows = materialize(_rows(docs, text, key, members, seed), "mix-rows")
    solved = solve(rows, targets or weighted_targets(), repeats)
    spark = docs.sparkSession
    known = [(s, solved.sizes[s], float(solved.targets[s])) for s in solved.sizes]
    sources = _side(spark, known, "_source string, source_size long, target double")
    out = _taken(rows, solved)
    out = out.join(sources, F.get("members", F.lit(0)).eqNullSafe(F.col("_source")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"))


def keep(docs: DataFrame, targets: Targets | None = None, text: str = "text", key: str = "doc_id", members: Column | None = None, seed: int = 7, repeats: int = 2) -> DataFrame:
    """The mixed corpus: every row of docs as often as it is taken, with the columns of docs."""
    members = F.array("source") if members is None else members
    rows = materialize(_rows(docs, text, key, members, seed).drop("doc_id"), "mix-rows")
    solved = solve(rows, targets or weighted_targets(), repeats)
    t = text_or_empty(text)
    packed = docs.select(F.struct(*docs.columns).alias("row"), _pattern(members).alias("pattern"), _order(F.col(key), t, seed).alias("order"), count_words(t).alias("size"))
    taken = _taken(packed, solved).filter("passes > 0 AND size > 0")
    return taken.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int")))).select("row.*")
