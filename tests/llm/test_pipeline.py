"""The whole pipeline against its stages by brute force."""

import collections
import re

import corpus_pipeline
from pulseloom.llm import mixing, quality
from tests.llm import cases
from tests.llm.test_operators import brute_classes


def test_run(spark, tmp_path):
    docs = cases.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    passed = {r["doc_id"] for r in quality.score(docs).filter("kept").collect()}
    last: dict = {}
    for row in cases.rows():
        if row[0] in passed and row[1]:
            last[row[1]] = max(last.get(row[1], -1), -1 if row[0] is None else row[0])
    good = {t: i for t, i in last.items() if len(re.findall(r"\S+", t)) >= 20}
    texts = sorted(good)
    stay = collections.defaultdict(list)
    for t, c in zip(texts, brute_classes(texts)):
        stay[c].append(good[t])
    ids = {max(v) for v in stay.values()}
    left = spark.createDataFrame([r for r in cases.rows() if (-1 if r[0] is None else r[0]) in ids and good.get(r[1]) == (-1 if r[0] is None else r[0])], cases.SCHEMA).dropDuplicates(["doc_id"])
    passes = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(left).collect()}
    got = collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert got == collections.Counter({i: n for i, n in passes.items() if n})


def test_stages_keep_the_columns(spark):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == cases.SCHEMA.replace(",", " ").split()[::2], name


def test_empty(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
