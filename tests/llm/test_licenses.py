"""License findings against a brute-force twin on sets of pairs of plain words, and whole published texts."""

import re
import textwrap

import numpy as np
import pytest

from pulseloom.llm import licenses
from tests.llm import cases

S = licenses.Settings()


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.fit(cases.documents(spark))


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def pairs(text):
    w = words(text)
    return set(zip(w, w[1:]))


TEMPLATES = [[pairs(t) for t in ts] for ts in licenses.templates().values()]
LONGEST = max(len(words(t)) for ts in licenses.templates().values() for t in ts)


def brute(text, model):
    """Findings (first line, last line, family, share) by looking at every run of lines."""
    lines = text.split("\n")

    def judge(i, j):
        own = "\n".join(lines[i : j + 1])
        p = model.probabilities(model.logits(own))[0, 1:]
        if p.max() < S.least_probability:
            return None
        k = int(p.argmax())
        shares = {(k, n): len(pairs(own) & t) / len(t) if len(t) > 1 else 0.0 for n, t in enumerate(TEMPLATES[k])}
        return (k, max(shares.values()), shares) if max(shares.values()) >= S.least_similarity else None

    out, held, runs = [], [{} for _ in lines], []

    def note(i, j, k, share, shares):
        out.append((i, j, licenses.FAMILIES[k + 1], share))
        for n in range(i, j + 1):
            held[n] = {t: max(held[n].get(t, 0), shares.get(t, 0)) for t in held[n] | shares}

    for i, line in enumerate(lines):
        if words(line) and (found := judge(i, i)):
            note(i, i, *found)
        j = i + 1
        while words(line) and j < len(lines) and words(lines[j]) and sum(len(words(x)) for x in lines[i + 1 : j]) < LONGEST:
            if found := judge(i, j):
                runs.append((-found[1], j - i, i, j, found))
            j += 1
    for _, _, i, j, found in sorted(runs, key=lambda r: r[:4]):
        if any(x >= S.least_similarity and x - max(held[n].get(t, 0) for n in range(i, j + 1)) > S.least_gain for t, x in found[2].items()):
            note(i, j, *found)
    return sorted(out)


def published(family, width, mark=""):
    """The statements of a family as a text that is wrapped at a width."""
    return "\n\n".join("\n".join(mark + x for x in textwrap.wrap(t, width)) for t in licenses.SENTENCES[family])


def test_findings_equal_brute_force(spark, classifier):
    r = np.random.default_rng(3)
    prose = [x for x in (row[1] for row in cases.rows()) if x and len(x) < 900]
    texts = [published(f, int(r.integers(30, 90)), ("", "// ", "# ")[i % 3]) for i, f in enumerate(licenses.SENTENCES)]
    texts += ["\n".join([prose[0][:300], published("MIT", 50), prose[1]]), published("BSD", 70).replace("\n\n", "\n"), published("ISC", 40).replace("\n\n", "\n")]
    for family in ("GPL", "Zlib", "Apache-2.0"):  # words are lost, lines end anywhere
        kept = [w for w in " ".join(licenses.SENTENCES[family]).split() if r.random() > 0.12]
        texts.append("\n".join(textwrap.wrap(" ".join(kept), 45)))
    texts += [f"{prose[2]}\nReleased under CC BY 3.0.\nLicensed under GPLv3, is MIT licensed.", "é MIT ü\nUNDER the\tterms", "", "\n\n", texts[0]]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").coalesce(2)
    got = {}
    for f in licenses.scan(df, classifier=classifier).collect():
        text = texts[f["doc_id"]]
        last = f["paragraph"] + text[f["start"] : f["start"] + f["n_chars"]].count("\n")
        assert len("".join(x + "\n" for x in text.split("\n")[: f["paragraph"]])) == f["start"]
        got.setdefault(f["doc_id"], []).append((f["paragraph"], last, f["family"], round(f["similarity"], 9)))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == [(*x[:3], round(x[3], 9)) for x in brute(text, classifier)], (i, text)
    assert len(got) > 20


def test_every_statement_of_published_texts_is_found(spark, classifier):
    families = list(licenses.SENTENCES)
    rows = [(i * 100 + n, t) for i, f in enumerate(families) for n, t in enumerate(licenses.SENTENCES[f])]
    wrapped = [(k + 10_000, "\n".join(textwrap.wrap(t, 60))) for k, t in rows]
    got = licenses.scan(spark.createDataFrame(rows + wrapped, "doc_id long, text string"), classifier=classifier).collect()
    found = {(f["doc_id"], f["family"]) for f in got}
    assert {(k, families[k % 10_000 // 100]) for k, _ in rows + wrapped} <= found
    assert all(f == families[k % 10_000 // 100] for k, f in found)


def test_notices_without_versions_are_found_and_prose_is_not(spark, classifier):
    notices = [
        ("Our data are licensed under CC BY 3.0, as are the maps.", "CC-BY"), ("It is licensed under GPLv3.", "GPL"), ("This library is MIT licensed.", "MIT"),
        ("Released under the Artistic License.", "Artistic-2.0"), ("Available under the zlib License", "Zlib"), ("Published under the WTFPL", "WTFPL"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Distributed under the terms of the LGPL.", "LGPL"),
    ]
    plain = [
        "The software was under review, and the board granted permission to use the bridge.", "You may use this file under the Acme License.", "MIT released a report under pressure.",
        "Anyone is free to copy the recipe, in either form, by any means.", "In no event shall the river be held liable for the damages of the flood.", "MIT License",
        "The warranty of the car is provided by the seller, without conditions of any kind.", "Everyone is permitted to walk in the park.",
    ]
    df = spark.createDataFrame(list(enumerate([x for x, _ in notices] + plain)), "doc_id long, text string")
    found = {f["doc_id"]: f["family"] for f in licenses.scan(df, classifier=classifier).collect()}
    assert found == {i: f for i, (_, f) in enumerate(notices)}


def test_very_long_texts_and_repeated_rows(spark, classifier):
    line = "wort " * 400_000
    text = f"{line}\nLicensed under the MIT License.\n{line}Released under CC0 1.0 Universal. {line}"
    rows = [(1, text), (1, text), (None, "Licensed under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), classifier=classifier).collect()
    assert sorted((f["doc_id"] or 0, f["paragraph"], f["start"]) for f in got if f["family"] == "MIT") == [(0, 0, 0), (1, 1, len(line) + 1), (1, 1, len(line) + 1)]
