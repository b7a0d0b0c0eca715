"""SimHash classes against brute force: fingerprints bit by bit, components by all pairs."""

import random

import numpy as np
import pytest
import xxhash

from pulseloom.llm import simhash
from tests.llm import cases


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_labels(fps, distance):
    """The smallest member of each fingerprint's component, by all pairs."""
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_of_awkward_texts():
    r = random.Random(1)
    texts = ["", " \n\t", "one", "one Two", "ÉCOLE Straße zwei", "a b c", "x" * 3000, cases.prose(r, 4000), "\x0b\x0ca\rb c d"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_a_long_text_is_cut_at_white_space(monkeypatch):
    text = cases.prose(random.Random(2), 300_000)
    assert len(text) > 1_500_000
    whole = slow_fingerprint(text)
    assert simhash.fingerprint(text.encode()) == whole
    monkeypatch.setattr(simhash, "CHUNK", 50)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(text[:5000].encode()) == slow_fingerprint(text[:5000])
    assert simhash.fingerprint(("y" * 200 + " b c " + "z" * 200).encode()) == slow_fingerprint("y" * 200 + " b c " + "z" * 200)


def test_classes(spark):
    docs = cases.documents(spark)
    rows = [(r[0], r[1]) for r in cases.rows()]
    out = simhash.classes(docs).collect()
    assert len(out) == len(rows)
    labels = slow_labels({slow_fingerprint(t) for _, t in rows}, 3)
    least = {}
    for i, t in rows:
        own = labels[slow_fingerprint(t)]
        least[own] = min((x for x in (i, least.get(own)) if x is not None), default=None)
    want = sorted(((i, f"{slow_fingerprint(t):016x}", least[labels[slow_fingerprint(t)]]) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in want if c is not None}
    assert simhash.classes(cases.empty(spark)).count() == 0 and simhash.keep(cases.empty(spark)).count() == 0


def fps_frame(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")


def labels_of(spark, fps, distance=3):
    found = {r["node"] % (1 << 64): r["label"] for r in simhash.components_of(fps_frame(spark, fps), distance).collect()}
    return found


def same_partition(found, fps, distance):
    arr = np.array(sorted(fps), np.uint64)
    label = simhash.connect(arr, distance)
    groups, mine = {}, {}
    for f, k in zip(arr.tolist(), label.tolist()):
        groups.setdefault(k, set()).add(f)
        mine.setdefault(found.get(f, ("alone", f)), set()).add(f)
    return sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
def test_no_link_is_lost(spark, distance):
    r = random.Random(distance)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for flips in range(0, distance + 3):
            for b in r.sample(range(64), flips):
                f ^= 1 << b
            fps.add(f)
    small = simhash.connect(np.array(sorted(fps), np.uint64), distance)
    slow = slow_labels(sorted(fps), distance)
    assert len(set(slow.values())) == len(set(small.tolist()))
    assert same_partition(labels_of(spark, fps, distance), fps, distance)


def test_large_buckets_are_compared_in_full(spark, monkeypatch):
    """One half of the bits is the same in all: some buckets hold all members, those of a piece more than the (lowered) limit too."""
    monkeypatch.setattr(simhash, "LIMIT", 100)
    r = random.Random(5)
    fps = {(r.getrandbits(10) << 32 | r.getrandbits(6) << 52) | 0xABCDEF01 for _ in range(900)}
    fps |= {r.getrandbits(32) << 32 | 0xABCDEF01 for _ in range(600)}
    fps |= {f ^ (1 << 63) ^ (1 << 3) ^ (1 << 50) for f in list(fps)[:50]}
    assert same_partition(labels_of(spark, fps), fps, 3)


def test_a_bucket_above_the_real_limit(spark):
    r = random.Random(6)
    fps = {r.getrandbits(32) << 32 | 0x1234567 for _ in range(3 * simhash.LIMIT)}
    fps |= {f ^ (1 << 40) ^ (1 << 45) ^ (1 << 2) for f in list(fps)[:200]}
    assert same_partition(labels_of(spark, fps), fps, 3)
