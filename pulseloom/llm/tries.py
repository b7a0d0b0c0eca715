"""How far sources of a language diverge in their terms, counted in mergeable radix tries.

Every task counts its documents' terms in byte tries whose leaves hold a
document count and a counter for each source; a trie is written out when it has
grown to a bounded size. A trie's key is language, NUL and term. It is kept in
preorder: for each leaf, in the order of its bytes, how much of the path of the
leaf before it shares, and the bytes that branch off there; so a trie is
compact, is walked in UTF-8 order, is cut at any prefix, and merges with others
leaf by leaf. Ranges of prefixes with about equal numbers of leaves are merged
each by one task, which then drops the rare terms. With the sums over all
ranges known, a walk over each merged trie streams the ranges' shares of the
pairs' values, and each source's foremost terms in the order of ties.

Defined cases: null text, language or source is ''; a text without terms counts
for no term, but its group is there; a repeated row is a document of its own;
very long texts are counted in parts; equal values rank in UTF-8 order of the
item; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import BROADCAST_ROWS, materialize, text_or_empty

MIN_DOCS, SMOOTHING, TOP = 30, 5, 50
#: Shares are counted in units of 1000 ** -SCALE_STEPS.
SCALE_STEPS = 3
#: Entries of a task's counters before its trie is written, bytes of a text that are split at once.
ENTRIES, CHUNK = 1 << 19, 1 << 20
#: Leaves (of all tries) that a range of prefixes is to hold, how many leaves one mark stands for, bytes of a mark.
RANGE_LEAVES, MARK_LEAVES, MARK_BYTES = 1 << 17, 256, 256
#: Ranges at most: their bounds are sent to all tasks.
MAX_RANGES = 50_000
#: Numbers of a matrix of terms and sources that is held at once.
CELLS = 1 << 20

#: A-Z in lower case, other letters (all bytes of non-ASCII characters too) as they are, everything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

TRIE = "shared binary, sizes binary, tails binary, docs binary, spread binary, places binary, counts binary, sources array<binary>"
_NAMES = ["shared", "sizes", "tails", "docs", "spread", "places", "counts", "sources"]


@dataclass
class Trie:
    """A radix trie in preorder. Leaf i branches off its predecessor's path after shared[i] bytes, with sizes[i] bytes of tails."""

    shared: np.ndarray
    sizes: np.ndarray
    tails: bytes
    docs: np.ndarray
    spread: np.ndarray  # counters of each leaf
    places: np.ndarray  # a counter's source
    counts: np.ndarray
    sources: list[bytes]

    @classmethod
    def of(cls, keys: list[bytes], docs: np.ndarray, spread: np.ndarray, places: np.ndarray, counts: np.ndarray, sources: list[bytes]) -> Trie:
        """The trie of distinct keys in order."""
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        data, start = np.frombuffer(b"".join(keys), np.uint8), np.cumsum(size) - size
        shared, open_ = np.zeros(len(keys), np.int64), np.arange(1, len(keys))
        while len(open_):
            depth = shared[open_]
            open_ = open_[(depth < size[open_]) & (depth < size[open_ - 1])]
            depth = shared[open_]
            open_ = open_[data[start[open_] + depth] == data[start[open_ - 1] + depth]]
            shared[open_] += 1
        tails = b"".join(k[s:] for k, s in zip(keys, shared.tolist()))
        return cls(shared, size - shared, tails, docs, spread, places, counts, sources)

    def walk(self) -> list[bytes]:
        """The keys, in the order of their bytes."""
        out, key, at, tails = [], b"", 0, self.tails
        for shared, size in zip(self.shared.tolist(), self.sizes.tolist()):
            key = key[:shared] + tails[at : at + size]
            at += size
            out.append(key)
        return out

    def part(self, keys: list[bytes], begin: int, end: int) -> Trie:
        """The leaves from begin to end; keys are those of all leaves."""
        cells = np.concatenate(([0], np.cumsum(self.spread)))
        inner = slice(cells[begin], cells[end])
        return Trie._with_used(keys[begin:end], self.docs[begin:end], self.spread[begin:end], self.places[inner], self.counts[inner], self.sources)

    @classmethod
    def _with_used(cls, keys: list[bytes], docs: np.ndarray, spread: np.ndarray, places: np.ndarray, counts: np.ndarray, sources: list[bytes]) -> Trie:
        used, places = np.unique(places, return_inverse=True)
        return cls.of(keys, docs, spread, places, counts, [sources[i] for i in used])

    def kept(self, keys: list[bytes], leaves: np.ndarray) -> tuple[list[bytes], Trie]:
        """The leaves that are marked."""
        cells = np.repeat(leaves, self.spread)
        some = [keys[i] for i in np.flatnonzero(leaves)]
        return some, Trie._with_used(some, self.docs[leaves], self.spread[leaves], self.places[cells], self.counts[cells], self.sources)

    def row(self) -> list:
        return [self.shared.astype("<u4").tobytes(), self.sizes.astype("<u4").tobytes(), self.tails, self.docs.astype("<u8").tobytes(),
                self.spread.astype("<u4").tobytes(), self.places.astype("<u4").tobytes(), self.counts.astype("<u8").tobytes(), self.sources]

    @classmethod
    def read(cls, row: dict) -> Trie:
        number = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
        return cls(number("shared", "<u4"), number("sizes", "<u4"), row["tails"], number("docs", "<u8"), number("spread", "<u4"), number("places", "<u4"), number("counts", "<u8"), row["sources"])


def merged(tries: list[Trie]) -> tuple[list[bytes], Trie]:
    """The keys and the trie of all leaves of some tries; counters of equal leaves and sources are added."""
    codes = pa.chunked_array([pa.array(t.walk(), pa.large_binary()) for t in tries]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    leaf = rank[codes.indices.to_numpy()]
    keys = codes.dictionary.take(pa.array(order)).to_pylist()
    names = sorted({s for t in tries for s in t.sources})
    index = {s: i for i, s in enumerate(names)}
    docs = np.zeros(len(keys), np.int64)
    np.add.at(docs, leaf, np.concatenate([t.docs for t in tries]))
    of_leaf = np.repeat(leaf, np.concatenate([t.spread for t in tries]))
    place = np.concatenate([np.array([index[s] for s in t.sources], np.int64)[t.places] for t in tries])
    cells, which = np.unique(of_leaf * max(1, len(names)) + place, return_inverse=True)
    counts = np.zeros(len(cells), np.int64)
    np.add.at(counts, which, np.concatenate([t.counts for t in tries]))
    spread = np.bincount(cells // max(1, len(names)), minlength=len(keys))
    return keys, Trie.of(keys, docs, spread, cells % max(1, len(names)), counts, names)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order; of a long text in parts that are cut between terms."""
    at = 0
    while len(text) - at > CHUNK:
        to = at + CHUNK
        while to < len(text) and _LETTERS[text[to]] != 32:
            to += 1
        yield text[at:to].translate(_LETTERS).split()
        at = to
    yield text[at:].translate(_LETTERS).split()


class _Counts:
    """What a task has counted since it last wrote a trie."""

    def __init__(self):
        self.docs: dict[bytes, Counter] = {}
        self.terms: dict[tuple[bytes, bytes], Counter] = {}

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        counter, seen = self.terms.setdefault((lang, source), Counter()), set()
        for terms in terms_of(text):
            counter.update(terms)
            seen.update(terms)
        self.docs.setdefault(lang, Counter()).update(seen)

    def entries(self) -> int:
        return sum(map(len, self.docs.values())) + sum(map(len, self.terms.values()))

    def trie(self) -> tuple[list[bytes], Trie]:
        # A language that another one begins with, behind its NUL, still has its own keys: terms hold no NUL.
        leaves = sorted((lang + b"\0" + term, n) for lang, c in self.docs.items() for term, n in c.items())
        keys, docs = [k for k, _ in leaves], np.array([n for _, n in leaves], np.int64)
        index = {k: i for i, k in enumerate(keys)}
        names = sorted({s for _, s in self.terms})
        place = {s: i for i, s in enumerate(names)}
        leaf, where, counts = [], [], []
        for (lang, source), counter in self.terms.items():
            leaf.append(np.fromiter((index[lang + b"\0" + t] for t in counter), np.int64, len(counter)))
            where.append(np.full(len(counter), place[source], np.int64))
            counts.append(np.fromiter(counter.values(), np.int64, len(counter)))
        leaf, where, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (leaf, where, counts))
        order = np.lexsort((where, leaf))
        return keys, Trie.of(keys, docs, np.bincount(leaf, minlength=len(keys)), where[order], counts[order], names)


def _record(columns: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_KINDS = [pa.binary()] * 7 + [pa.list_(pa.binary())]


def _rows(tries: list[tuple[list, Trie]], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """Rows of some values and a trie."""
    data = [[*first, *trie.row()] for first, trie in tries]
    return _record([[r[i] for r in data] for i in range(len(names) + 8)], [*names, *_NAMES], [*kinds, *_KINDS])


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs -> the tasks' tries, with marks: every MARK_LEAVES-th key."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()

        def written() -> Iterator[pa.RecordBatch]:
            keys, trie = held.trie()
            if keys:
                yield _rows([([[k[:MARK_BYTES] for k in keys[::MARK_LEAVES]]], trie)], ["marks"], [pa.list_(pa.binary())])

        for batch in batches:
            for i, row in enumerate(zip(*(batch.column(c).cast(pa.binary()) for c in ("lang", "source", "text"))), 1):
                held.add(*(x.as_py() for x in row))
                if i % 16 == 0 and held.entries() > ENTRIES:
                    yield from written()
                    held = _Counts()
        yield from written()

    rows = docs.select(*(text_or_empty(F.col(c).cast("string")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    return rows.mapInArrow(of, f"marks array<binary>, {TRIE}")


def bounds_of(tries: DataFrame) -> list[bytes]:
    """The first keys of ranges that hold about RANGE_LEAVES leaves each; MAX_RANGES at most, of MARK_BYTES bytes."""
    marks = tries.select(F.explode("marks").alias("mark"))
    ranges = min(MAX_RANGES, 1 + marks.count() * MARK_LEAVES // RANGE_LEAVES)
    dealt = marks.repartitionByRange(ranges, "mark").groupBy(F.spark_partition_id().alias("range")).agg(F.min("mark").alias("bound"))
    return sorted(bytes(r["bound"]) for r in dealt.collect())[1:]


def merge(tries: DataFrame, keep: Callable[[Trie], np.ndarray]) -> DataFrame:
    """Tries -> (lang, trie): the merged trie of each range of prefixes and language, with the leaves that ``keep`` marks."""
    bounds = bounds_of(tries)

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                trie = Trie.read(row)
                keys = trie.walk()
                of = np.array([bisect_right(bounds, k) for k in keys], np.int64)
                at = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1], np.ones(1, bool))))
                parts = [([int(of[a])], trie.part(keys, a, b)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield _rows(parts, ["range"], [pa.int32()])

    def joined(rows: pa.Table) -> pa.Table:
        keys, trie = merged([Trie.read(r) for r in rows.to_pylist()])
        keys, trie = trie.kept(keys, keep(trie))
        langs = [k[: k.rindex(b"\0")] for k in keys]
        at = [0, *(i for i in range(1, len(keys)) if langs[i] != langs[i - 1]), len(keys)] if keys else [0]
        # Leaves of a language are neighbours unless another one's name goes on behind a NUL; then it has several rows.
        return pa.Table.from_batches([_rows([([langs[a].decode()], trie.part(keys, a, b)) for a, b in zip(at, at[1:])], ["lang"], [pa.string()])])

    parts = tries.select(*_NAMES).mapInArrow(cut, f"range int, {TRIE}")
    return parts.groupBy("range").applyInArrow(joined, f"lang string, {TRIE}")


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The merged tries (lang, trie) of the terms that at least min_docs documents of their language have."""
    tries = materialize(counted(docs, text, lang, source), "tries")
    return materialize(merge(tries, lambda trie: trie.docs >= min_docs), "merged")


def counts(tries: DataFrame) -> DataFrame:
    """Merged tries -> lang, term, docs, source, count."""

    def of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                trie = Trie.read(row)
                keys = [k[k.rindex(b"\0") + 1 :].decode() for k in trie.walk()]
                leaf = np.repeat(np.arange(len(keys)), trie.spread)
                names = [s.decode() for s in trie.sources]
                yield _record(
                    [[row["lang"]] * len(leaf), [keys[i] for i in leaf], trie.docs[leaf], [names[p] for p in trie.places], trie.counts],
                    ["lang", "term", "docs", "source", "count"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()],
                )

    return tries.mapInArrow(of, "lang string, term string, docs long, source string, count long")


def _totals(tries: DataFrame) -> DataFrame:
    """(lang, source, n, v) of each merged trie: occurrences of its terms in a source; in a row without a source, its number of terms."""

    def of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                trie = Trie.read(row)
                sums = np.zeros(len(trie.sources), np.int64)
                np.add.at(sums, trie.places, trie.counts)
                names = [*(s.decode() for s in trie.sources), None]
                yield _record([[row["lang"]] * len(names), names, [*sums, 0], [0] * len(sums) + [len(trie.docs)]], ["lang", "source", "n", "v"], [pa.string(), pa.string(), pa.int64(), pa.int64()])

    return tries.mapInArrow(of, "lang string, source string, n long, v long")


def share(count: np.ndarray, total: np.ndarray, steps: int = SCALE_STEPS) -> np.ndarray:
    """1 + floor(1000 ** steps * count / total) by long division in base 1000: exact while total is below 9e15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(steps):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _walks(rows: DataFrame, smoothing: int, top: int) -> DataFrame:
    """Merged tries with their language's groups -> (part, lang, source, item, value): shares of the pairs' values, and foremost terms."""
    kinds = [pa.string()] * 4 + [pa.int64()]
    names = ["part", "lang", "source", "item", "value"]

    def of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lang, groups = row["lang"], row["groups"]
                sources, v = [g["source"] for g in groups], row["v"]
                totals = np.array([g["n"] for g in groups], np.int64) + smoothing * v
                whole = np.int64(sum(g["n"] for g in groups) + smoothing * v)
                index = {s.encode(): i for i, s in enumerate(sources)}
                trie = Trie.read(row) if row["shared"] is not None else None
                n = len(trie.docs) if trie else 0
                keys = trie.walk() if trie else []
                cells = np.concatenate(([0], np.cumsum(trie.spread))) if trie else np.zeros(1, np.int64)
                place = np.array([index[s] for s in trie.sources], np.int64)[trie.places] if trie else cells[:0]
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(sources)
                step = max(1, CELLS // len(sources))
                for a in range(0, len(sources), step):
                    mine = range(a, min(a + step, len(sources)))
                    pairs = np.zeros((len(mine), len(sources)), np.int64)
                    for at in range(0, n, step):
                        to = min(at + step, n)
                        inner = slice(cells[at], cells[to])
                        count = np.zeros((to - at, len(sources)), np.int64)
                        count[np.repeat(np.arange(to - at), trie.spread[at:to]), place[inner]] = trie.counts[inner]
                        p = share(count + smoothing, totals)
                        q = share(count.sum(1) + smoothing, whole)
                        for i in mine:
                            pairs[i - a] += np.abs(p - p[:, i : i + 1]).sum(0)
                            leaf = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                            value = np.concatenate((best[i][0], p[leaf, i] - q[leaf]))
                            leaf = np.concatenate((best[i][1], leaf + at))
                            # Leaves come in UTF-8 order, which a stable sort keeps among ties.
                            first = np.argsort(-value, kind="stable")[:top]
                            best[i] = value[first], leaf[first]
                    for i in mine:
                        others = [j for j in range(len(sources)) if j != i]
                        yield _record([["pair"] * len(others), [lang] * len(others), [sources[i]] * len(others), [sources[j] for j in others], pairs[i - a, others]], names, kinds)
                for i, (value, leaf) in enumerate(best):
                    terms = [keys[x][keys[x].rindex(b"\0") + 1 :].decode() for x in leaf]
                    yield _record([["term"] * len(terms), [lang] * len(terms), [sources[i]] * len(terms), terms, value], names, kinds)

    return rows.mapInArrow(of, "part string, lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the other ones by divergence (pair), and its foremost terms (term)."""
    tries = vocabulary(docs, min_docs, text, lang, source)
    sums = materialize(_totals(tries).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("v").alias("v")), "totals")
    groups = docs.select(*(text_or_empty(F.col(c).cast("string")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    groups = groups.join(sums.filter("source IS NOT NULL").drop("v"), ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list("g")).alias("groups"))
    langs = langs.join(sums.filter("source IS NULL").select("lang", "v"), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = materialize(langs, "languages")
    total = langs.agg(F.sum(F.size("groups"))).first()[0] or 0
    rows = _with_languages(langs, tries, total <= BROADCAST_ROWS)
    found = materialize(_walks(rows, smoothing, top), "walks")
    pairs = found.filter("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("part", "lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_value))
    out = ranked(pairs).unionByName(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _with_languages(langs: DataFrame, tries: DataFrame, few: bool) -> DataFrame:
    """Every merged trie with its language's groups, broadcast if they are few; languages without a trie have a row without one."""
    rows = tries.join(F.broadcast(langs) if few else langs, "lang")
    bare = langs.filter("v = 0")
    nothing = [F.lit(None).cast(tries.schema[c].dataType).alias(c) for c in _NAMES]
    return rows.unionByName(bare.select(*langs.columns, *nothing))
