"""Tries against plain sets and counters, and the divergence audit against a count of everything in one process."""

import collections
import random
import re

import numpy as np
import pytest

from pulseloom.llm import tries
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_trie(r, keys=200, sources=4):
    names = sorted({f"s{r.randrange(9)}".encode() for _ in range(sources)})
    table = {bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.randint(0, 7))): {r.randrange(len(names)): r.randint(1, 9) for _ in range(r.randint(0, 3))} for _ in range(keys)}
    keys = sorted(table)
    cells = [sorted(table[k].items()) for k in keys]
    docs = np.array([r.randint(1, 5) for _ in keys], np.int64)
    trie = tries.Trie.of(keys, docs, np.array([len(c) for c in cells]), np.array([p for c in cells for p, _ in c], np.int64), np.array([n for c in cells for _, n in c], np.int64), names)
    return trie, {k: (int(d), {names[p]: n for p, n in c}) for k, d, c in zip(keys, docs, cells)}


def content(keys, trie):
    at, out = 0, {}
    for i, k in enumerate(keys):
        n = int(trie.spread[i])
        out[k] = (int(trie.docs[i]), {trie.sources[p]: int(c) for p, c in zip(trie.places[at : at + n], trie.counts[at : at + n])})
        at += n
    return out


def test_tries_walk_cut_and_merge():
    r = random.Random(3)
    made = [random_trie(r) for _ in range(5)]
    for trie, table in made:
        keys = trie.walk()
        assert keys == sorted(table) and content(keys, trie) == table
        again = tries.Trie.read(dict(zip(tries._NAMES, trie.row())))
        assert content(again.walk(), again) == table
        part = trie.part(keys, 7, 31)
        assert content(part.walk(), part) == {k: table[k] for k in keys[7:31]}
    want = {}
    for _, table in made:
        for k, (docs, cells) in table.items():
            old = want.setdefault(k, [0, collections.Counter()])
            old[0] += docs
            old[1].update(cells)
    keys, trie = tries.merged([t for t, _ in made])
    assert keys == sorted(want) == trie.walk()
    assert content(keys, trie) == {k: (d, dict(c)) for k, (d, c) in want.items()}
    keys, empty = trie.kept(keys, np.zeros(len(keys), bool))
    assert keys == [] == empty.walk()


def test_terms_of_long_texts(monkeypatch):
    text = "Ab1cÉd-ef_gh\x00İi " * 200 + "x" * 500
    want = TERM.findall(text.translate(LOWER))
    monkeypatch.setattr(tries, "CHUNK", 37)
    assert [t.decode() for part in tries.terms_of(text.encode()) for t in part] == want


def test_shares_are_exact():
    r = random.Random(4)
    for _ in range(500):
        total = r.randint(1, 8 * 10**15)
        count = r.randint(0, total)
        assert int(tries.share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total


def slow_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    seen, found, groups = collections.Counter(), collections.Counter(), {(a, b) for a, b, _ in docs}
    for lang, source, terms in docs:
        seen.update((lang, t) for t in set(terms))
        found.update((lang, source, t) for t in terms)
    out = []
    for lang, source in groups:
        kept = sorted(t for (a, t), n in seen.items() if a == lang and n >= min_docs)
        sources = sorted(b for a, b in groups if a == lang)

        def shares(names):
            counts = [sum(found[lang, s, t] for s in names) for t in kept]
            return [1 + 10**9 * (c + 5) // (sum(counts) + 5 * len(kept)) for c in counts]

        mine, whole = shares([source]), shares(sources)
        pairs = [(-sum(abs(a - b) for a, b in zip(mine, shares([s]))), s.encode(), s) for s in sources if s != source]
        terms = [(q - p, t.encode(), t) for t, p, q in zip(kept, mine, whole) if found[lang, source, t] and p > q]
        out += [(lang, source, "pair", s, -v, i) for i, (v, _, s) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:  # many small tries and ranges, and matrices of few numbers
        for name, value in (("ENTRIES", 300), ("MARK_LEAVES", 4), ("RANGE_LEAVES", 40), ("CELLS", 8), ("CHUNK", 64)):
            monkeypatch.setattr(tries, name, value)
    rows = [(r[1], r[2], r[3]) for r in cases.rows()] + [("only here", "xx", "s9"), (None, "xx", "s8"), ("alpha beta", "en", "s1"), ("alpha beta", "en", "s1"), ("Zoë beta alpha", "en\0fr", "s0"), ("alpha beta", "en\0fr", None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, rank int").repartition(4)
    got = sorted(tuple(r) for r in tries.audit(docs, min_docs=2, top=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == slow_audit(rows, 2, 7)
    counts = tries.counts(tries.vocabulary(docs, 2)).filter("term = 'beta' AND lang = 'en'").collect()
    assert [tuple(r) for r in counts] == [("en", "beta", 2, "s1", 2)]


def test_empty(spark):
    assert tries.audit(cases.empty(spark)).count() == 0
