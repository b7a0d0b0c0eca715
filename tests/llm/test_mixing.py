"""Mixes of very many sources, and of sources alone beside sources that overlap."""

import itertools
import random

from pyspark.sql import functions as F

from pulseloom.llm import mixing
from pulseloom.llm.mixing import weighted_targets


def test_more_sources_than_a_network_could_hold(spark):
    n = 120_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("three words here").alias("text"), F.format_string("s%07d", "id").alias("source"))
    out = mixing.mix(docs).toPandas().sort_values("doc_id")
    assert len(out) == n and (out["size"] == 3).all() and (out["source_size"] == 3).all()
    targets = weighted_targets()({f"s{i:07d}": 3 for i in range(n)})
    assert (out["target"].to_numpy() == [float(targets[f"s{i:07d}"]) for i in range(n)]).all()
    assert out["taken"].isin([0, 3, 6]).all()
    # Weights 3, 1, 2: the first has reached twice its size, and no document can give a part of itself.
    assert (out["taken"].to_numpy()[::3] == 6).all()
    assert ((out["taken"] - out["target"]).abs() <= 1.5).all()


def test_lone_sources_flow_as_in_the_network():
    r = random.Random(3)
    for _ in range(50):
        names = "abcde"
        patterns = {(s,): r.randint(0, 40) for s in names}
        patterns |= {p: r.randint(0, 40) for p in itertools.combinations("abc", 2) if r.random() < 0.5}
        quotas = {s: r.randint(0, 90) for s in names}
        got, whole = mixing.route(patterns, quotas, 2), mixing._network(patterns, quotas, 2)
        total = lambda flows: sum(sum(f.values()) for f in flows.values())
        assert total(got) == total(whole)
        for s in "de":
            assert got[(s,)] == whole[(s,)] == {s: min(2 * patterns[(s,)], quotas[s])}
        for p, f in got.items():
            assert sum(f.values()) <= 2 * patterns[p]
