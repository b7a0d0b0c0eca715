"""Language-model scores of whole documents by a gated recurrent network that is trained here.

Counts of all words of all training documents are gathered first; they give the
base score and the shares within tail classes. The network is trained on all
training documents, whole, the state being carried over windows: a start on the
driver with a bounded number of tokens, then every task goes on from there with
its own documents, and the tasks' parameters are averaged by their tokens. All
documents are then scored whole in the same way. Texts are coded once, with what
their counts give; training and scoring read the codes.

The counts of the most frequent words are broadcast up to a fixed number; for
all other words documents are joined with the full table of counts.

Defined cases: a null text is empty and has its end alone; a null doc_id counts
as an empty one for the fold; repeated rows are scored alike; an empty table
gives an empty result; further columns are ignored. With no training documents
all counts are 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import first_by, materialize, text_or_empty
from pulseloom.llm.gru import Shape, Trainer, score, start, tail_class, tail_classes


@dataclass(frozen=True)
class Settings:
    folds: int = 7
    held_out: int = 2
    #: One of so many training documents trains the network; 1: all of them.
    share: int = 1
    #: Tokens of the start on the driver, at most.
    first_tokens: int = 300_000
    #: Words whose counts are broadcast.
    known_words: int = 1 << 17
    #: Different words that a task counts before it hands them on.
    counted: int = 400_000
    #: Characters of a text of that start, at most.
    first_chars: int = 1 << 14
    #: Texts that are scored side by side.
    together: int = 4096
    #: Tasks whose parameters are averaged at once.
    averaged: int = 32


def _fold(key: str, s: Settings):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % s.folds


def _words(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes split at the six white-space characters alone."""
    return text.encode("utf-8", "replace").lower().split()


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all of them, as _words has them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    n, words = pc.list_value_length(lists).to_numpy(), lists.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty ones
    kept = some.to_numpy(zero_copy_only=False)
    if not kept.all():
        n, words = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n)), words.filter(some)
    return n, words


def _parts(batches, s: Settings):
    return (batch.slice(at, s.together) for batch in batches for at in range(0, batch.num_rows, s.together))


def word_counts(training: DataFrame, s: Settings) -> DataFrame:
    """(word binary, n) over all texts."""

    def count(batches):
        found: list[pa.Table] = []
        for part in _parts(batches, s):
            counted = _split(part.column(0))[1].value_counts()
            found.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
            if sum(map(len, found)) > s.counted:
                found = [pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])]
                if len(found[0]) > s.counted:
                    yield from found.pop().to_batches()
        for table in found:
            yield from table.to_batches()

    return training.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Symbols and counts of the frequent words, and the sums that the probabilities need."""

    counts: dict[bytes, int]
    symbols: dict[bytes, int]
    tokens: int  # N
    types: int  # V
    ends: int
    tail_sizes: np.ndarray  # words and different words of each tail class, plus one

    def symbol(self, word: bytes, shape: Shape) -> int:
        found = self.symbols.get(word)
        return shape.head + tail_class(word) if found is None else found


def _tails(table: DataFrame) -> dict[int, tuple[int, int]]:
    """Words and different words of each tail class of a table of counts: as many rows as there are classes."""

    def sums(batches):
        n, types = np.zeros(27, np.int64), np.zeros(27, np.int64)
        for batch in batches:
            at = tail_classes(batch.column(0))
            n += np.bincount(at, weights=batch.column(1).to_numpy(), minlength=27).astype(np.int64)
            types += np.bincount(at, minlength=27)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27)), pa.array(n), pa.array(types)], ["tail", "n", "types"])

    summed = table.select("word", "n").mapInArrow(sums, "tail long, n long, types long").groupBy("tail").agg(F.sum("n"), F.sum("types"))
    return {r[0]: (r[1], r[2]) for r in summed.collect()}


def vocabulary(counts: DataFrame, ends: int, shape: Shape, s: Settings) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, and the counts of head members and of classes."""
    # The count from which on words are few enough to be known, to an eighth of a power of two.
    size = F.floor(8 * F.log2("n")).alias("size")
    least, many = None, 0
    for r in sorted(counts.groupBy(size).count().collect(), key=lambda r: -r["size"]):
        many += r["count"]
        if many > s.known_words:
            break
        least = r["size"]
    frequent = counts.filter(size >= least) if least is not None else counts.orderBy(F.desc("n"), "word").limit(shape.head)
    top = sorted(((bytes(r["word"]), r["n"]) for r in frequent.collect()), key=lambda x: (-x[1], x[0]))
    total = counts.agg(F.sum("n"), F.count("*")).first()
    head = top[: shape.head]
    member = np.zeros(shape.head_classes * shape.per_class)
    member[: len(head)] = [n for _, n in head]
    tails = _tails(counts)
    sizes = np.array([tails.get(k, (0, 0)) for k in range(shape.tails)], dtype=np.int64)
    for w, n in head:
        sizes[tail_class(w)] -= n, 1
    per_class = member.reshape(shape.head_classes, shape.per_class)
    classes = np.concatenate((per_class.sum(axis=1), sizes[:, 0], [ends]))
    symbols = {w: i if i < shape.head else shape.head + tail_class(w) for i, (w, _) in enumerate(top)}
    vocab = Vocabulary(dict(top), symbols, (total[0] or 0) + ends, total[1] + (ends > 0), ends, sizes.sum(axis=1) + 1)
    return vocab, per_class, classes


def _looked_up(words: list[bytes], of: dict[bytes, int], missing: int) -> np.ndarray:
    return np.fromiter(map(of.get, words, repeat(missing)), np.int64, len(words))


def _coded(words: list[bytes], vocab: Vocabulary, shape: Shape) -> np.ndarray:
    codes = np.append(_looked_up(words, vocab.symbols, -1), shape.end).astype(np.int32)
    for i in np.flatnonzero(codes < 0).tolist():
        codes[i] = shape.head + tail_class(words[i])
    return codes


class Coder:
    """Codes of many texts at once, and what else their words give."""

    def __init__(self, vocab: Vocabulary, shape: Shape):
        self.vocab, self.shape = vocab, shape
        self.words = pa.array(list(vocab.counts), pa.binary())
        # The last of each is for words that are not among them.
        self.symbols = np.array([*(vocab.symbols[w] for w in vocab.counts), 0], np.int32)
        self.logs = np.log10(np.array([*vocab.counts.values(), 0]) + 1.0)
        self.tail_logs = np.zeros(shape.symbols)
        self.tail_logs[shape.head : shape.end] = np.log10(vocab.tail_sizes)
        self.kind = np.min_scalar_type(shape.end)

    def code(self, texts: pa.Array) -> list[pa.Array]:
        """For each text: tokens, known tokens, base score, what is to be added to the network's score, codes, and each word that has no count here and how often it occurs."""
        if not len(texts):
            return [pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))]
        vocab, shape = self.vocab, self.shape
        n, words = _split(texts)
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        missing = at < 0
        rare = words.filter(pa.array(missing))
        symbols, sizes = self.symbols[at], n + 1
        symbols[missing] = shape.head + tail_classes(rare)
        starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
        inner = np.ones(int(sizes.sum()), bool)
        inner[ends] = False
        codes, logs, seen = np.full(len(inner), shape.end, self.kind), np.full(len(inner), np.log10(vocab.ends + 1.0)), np.full(len(inner), int(vocab.ends > 0))
        codes[inner], logs[inner], seen[inner] = symbols, self.logs[at], ~missing
        tail = np.where((codes >= shape.head) & (codes < shape.end), logs, 0) - self.tail_logs[codes]
        base, extra, seen = (np.add.reduceat(x, starts) for x in (logs, tail, seen))
        base -= sizes * np.log10(vocab.tokens + vocab.types + 1)
        places = np.append(starts, len(codes)) * codes.itemsize
        coded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(codes)])
        words, times, many = _grouped(rare, np.repeat(np.arange(len(n)), n)[missing], len(n))
        return [pa.array(sizes, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(extra), coded, pa.ListArray.from_arrays(many, words), pa.ListArray.from_arrays(many, times)]


def _grouped(words: pa.Array, texts: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The different words of each of n texts, how often each occurs there, and where a text's begin. texts: the text of each word."""
    named = words.dictionary_encode()
    pairs, times = np.unique(texts * max(1, len(named.dictionary)) + named.indices.to_numpy(), return_counts=True)
    of, word = np.divmod(pairs, max(1, len(named.dictionary)))
    many = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))
    return named.dictionary.take(pa.array(word)), pa.array(times, pa.int64()), pa.array(many, pa.int32())


def _sequences(coded: pa.Array, shape: Shape) -> list[np.ndarray]:
    return [np.frombuffer(x, np.min_scalar_type(shape.end)) for x in coded.to_pylist()]


def train(sample: DataFrame, vocab, parameters: dict, shape: Shape, s: Settings, coded: DataFrame | None = None) -> dict:
    """sample (text): texts for the network, all of which are learned whole, each once in a stream of its task. vocab: broadcast.

    coded (codes): the same texts, if they were coded already.
    """
    spark = sample.sparkSession
    few = max(1, s.first_tokens // 200)
    short = sample.filter(F.length("text") <= s.first_chars)
    first, used = [], 0
    for r in first_by(short, F.xxhash64("text"), few).orderBy("text").limit(few).collect():
        codes = _coded(_words(r["text"]), vocab.value, shape)
        used += len(codes)
        if used > s.first_tokens:
            break
        first.append(codes)
    trainer = Trainer(parameters, shape)
    trainer.learn(first)
    shared = spark.sparkContext.broadcast(trainer.p)
    names, done = sorted(parameters), coded is not None

    def averages(part: int, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        """The mean of parameters, weighted by tokens."""
        tokens = sum(n for n, _ in found)
        mean = sum(p * (n / tokens) for n, p in found).astype(np.float32).tobytes() if tokens else b""
        rows = [[part], [tokens], [mean]] if tokens else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.binary()))], ["part", "tokens", "mean"])

    def own(batches):
        mine = Trainer(shared.value, shape)
        coder = None if done else Coder(vocab.value, shape)
        columns = (part.column(0) if done else coder.code(part.column(0))[4] for part in _parts(batches, s))
        # The longest of a part first, so that lanes end together.
        mine.learn(c for column in columns for c in sorted(_sequences(column, shape), key=len, reverse=True))
        flat = np.concatenate([mine.p[k].ravel() for k in names])
        yield averages(TaskContext.get().partitionId(), [(mine.tokens, flat)] if mine.tokens else [])

    def mean(rows: pa.Table) -> pa.Table:
        found = [(n, np.frombuffer(x, np.float32).astype(np.float64)) for n, x in zip(rows["tokens"].to_pylist(), rows["mean"].to_pylist())]
        return pa.Table.from_batches([averages(rows["part"][0].as_py() // s.averaged, found)])

    kind = "part long, tokens long, mean binary"
    given = sample.select("text") if coded is None else coded.select("codes")
    level, many = materialize(given.mapInArrow(own, kind), "parameters"), given.rdd.getNumPartitions()
    while many > s.averaged:
        level = level.groupBy(F.floor(F.col("part") / s.averaged)).applyInArrow(mean, kind)
        many = -(-many // s.averaged)
    found = [(r["tokens"], np.frombuffer(r["mean"], np.float32).astype(np.float64)) for r in level.collect()]
    if not found:
        return trainer.p
    flat, out, at = np.frombuffer(averages(0, found).column(2)[0].as_py(), np.float32), {}, 0
    for k in names:
        n = parameters[k].size
        out[k] = flat[at : at + n].reshape(parameters[k].shape).copy()
        at += n
    return out


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", shape: Shape = Shape(), s: Settings = Settings()) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), (_fold(key, s) == s.held_out).alias("held_out"))
    training = chosen.filter("NOT held_out")
    counts = materialize(word_counts(training, s), "word-counts")
    ends = training.count()
    vocab, member, classes = vocabulary(counts, ends, shape, s)
    known = spark.sparkContext.broadcast(vocab)
    sample = training if s.share == 1 else training.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(s.share)) == 0)

    def code(batches):
        place = TaskContext.get().partitionId() << 36
        coder = Coder(known.value, shape)
        for part in _parts(batches, s):
            rows = pa.array(range(place, place + part.num_rows), pa.int64())
            place += part.num_rows
            yield pa.RecordBatch.from_arrays([rows, part.column(0), part.column(2), part.column(3), *coder.code(part.column(1))], names)

    kept = "row long, doc_id long, held_out boolean, sampled boolean, n_tokens long, n_known long, base_score double"
    kind = f"{kept}, extra double, codes binary, rare array<binary>, times array<long>"
    names = [column.split()[0] for column in kind.split(", ")]
    chosen = chosen.withColumn("sampled", ~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(s.share)) == 0))
    coded = materialize(chosen.mapInArrow(code, kind), "coded")
    trained = spark.sparkContext.broadcast(train(sample, known, start(shape, member, classes), shape, s, coded.filter("sampled")))

    def of(batches):
        for part in _parts(batches, s):
            modelled = score(trained.value, shape, _sequences(part.column("codes"), shape)) / np.log(10) + part.column("extra").to_numpy()
            columns = [part.column(name) for name in names[:7]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(modelled, pa.float64())], [*names[:7], "score"])

    scored = coded.drop("rare", "times").mapInArrow(of, f"{kept}, score double")
    scored = materialize(scored, "scored")
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    out = scored.join(found, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
