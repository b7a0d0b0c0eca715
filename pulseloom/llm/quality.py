"""Quality rules on documents and on their hosts, in DataFrame functions only.

A document fails a rule when it is too short, repeats itself, is full of
symbols or repeated lines, or has words of an odd mean length. The failures of
each host are counted, its rate is shrunk towards that of all hosts by a beta
prior fitted to the hosts' own rates, and a host whose shrunk rate is above a
limit is rejected with all its documents.

Defined cases: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows are scored one by one and count one by one for
their host; an empty table gives an empty result; further columns of the input
are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import BROADCAST_ROWS, SPACE_CHARS, let, materialize, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the document rules, of the host rule and of the prior."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_symbols_per_word: float = 0.5
    max_dup_line_share: float = 0.3
    min_mean_word: float = 2.0
    max_mean_word: float = 15.0
    max_host_rate: float = 0.5
    #: Bounds on the prior's weight in documents, for hosts that all have the same rate or have nothing in common.
    prior_weight: tuple[float, float] = (1.0, 10_000.0)


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more: windows are sorted by hash, equal neighbours mark their starts."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(F.slice(words, i + 1, window)))

    def starts(sorted_pairs: Column) -> Column:
        same = lambda e, other: F.coalesce(F.get(sorted_pairs, other)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(sorted_pairs, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda s, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - s, F.lit(window)))), F.lit(0), lambda a, x: a + x
        )

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda p: let(starts(p), covered)))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, count))


def features(text: Column, rules: Rules = Rules()) -> Column:
    """The counts of one text as a struct: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)

    def build(words: Column) -> Column:
        return let(
            lines,
            lambda ls: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                _repeat_words(words, rules.window).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(words_of(text), build)


def base_failed(f: Column, rules: Rules = Rules()) -> Column:
    return (f["n_words"] < rules.min_words) | (100 * f["n_repeat_words"] > rules.max_repeat_percent * f["n_words"])


def any_failed(f: Column, rules: Rules = Rules()) -> Column:
    """Whether a document fails any rule; this is what its host is judged by."""
    return (
        base_failed(f, rules)
        | (f["n_symbols"] > rules.max_symbols_per_word * f["n_words"])
        | (f["n_dup_lines"] > rules.max_dup_line_share * f["n_lines"])
        | (f["word_chars"] < rules.min_mean_word * f["n_words"])
        | (f["word_chars"] > rules.max_mean_word * f["n_words"])
    )


def host_verdicts(scored: DataFrame, host: str, failed: str, rules: Rules = Rules()) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    The prior is Beta(m w, (1 - m) w): m is the failure rate of all documents, w
    comes from how far the hosts' rates scatter beyond what their sizes explain.
    """
    hosts = scored.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    total = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failures").alias("k"), F.count("*").alias("hosts")).first()
    n, k, count = total["n"] or 0, total["k"] or 0, total["hosts"]
    mean = k / n if n else 0.0
    low, high = rules.prior_weight
    weight = high
    if count > 1 and 0 < mean < 1:
        scatter = hosts.agg(F.sum(F.col("host_docs") * (rate - mean) ** 2).alias("s")).first()["s"] / n
        chance = mean * (1 - mean) * count / n
        between = scatter - chance
        weight = min(high, max(low, mean * (1 - mean) / between - 1)) if between > 0 else high
    shrunk = (F.col("host_failures") + mean * weight) / (F.col("host_docs") + weight)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > rules.max_host_rate)


def _judge(rows: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    hosts = hosts.withColumnRenamed(host, "_host")
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    return rows.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")


def score(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", rules: Rules = Rules()) -> DataFrame:
    """A row for each document: its counts, whether it fails the base rules, its host's shrunk rate, and the verdict."""
    f = F.col("_f")
    counted = docs.select(key, host, features(text_or_empty(text), rules).alias("_f"))
    counted = counted.select(key, host, "_f.*", base_failed(f, rules).alias("base_failed"), any_failed(f, rules).alias("any_failed"))
    counted = materialize(counted, "quality")
    judged = _judge(counted, host_verdicts(counted, host, "any_failed", rules), host)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def keep(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Texts are scored once and never shuffled: each row is
    written with its verdict, without its content where the base rules reject it, and read again for the hosts'."""
    f = F.col("_f")
    scored = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("_host"), features(text_or_empty(text), rules).alias("_f"))
    scored = materialize(scored.select("_host", any_failed(f, rules).alias("_failed"), F.when(~base_failed(f, rules), F.col("row")).alias("row")), "judged")
    bad = host_verdicts(scored, "_host", "_failed", rules).filter("host_rejected").select(F.col("_host").alias("_bad_host"))
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return scored.filter("row IS NOT NULL").join(bad, F.col("_host").eqNullSafe(F.col("_bad_host")), "left_anti").select("row.*")
