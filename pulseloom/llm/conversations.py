"""Repair of the structure of conversations at the least cost.

A conversation's turns are taken by turn number, nulls first, then by role and
text. The first fault of a turn counts: blank (no word), duplicate (its role and
text were seen earlier), truncated (its last character that isn't white space
is none of . ! ?). Blank and duplicate turns are deleted; the other edits that
make the roles follow ``(s?(ua)+)?`` are the cheapest ones, found by the cost
layers of ``grammar``.

Conversations of up to LONG_TURNS turns and LONG_CHARS characters come in order
in the rows of a task, some thousands of them go through the layers at once. A
longer one is not held anywhere: its turns are dealt to tasks by ranges, equal
ones counted first; each task's piece of it is a matrix of costs, a number for
each turn leaves a task, and the pieces are repaired on their own once the
matrices of all are combined. Only the audit of a conversation, a row of the
result, and the digest of its text, which is read in a stream, are as long as it.

Defined cases: null roles and texts are one space, so that such a text is blank
and such a role has to go; null turns come first and don't count for gaps; null
conversation ids are one conversation; equal rows are duplicates of the first;
turns that are over 2**63 apart wrap; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulseloom.llm import grammar
from pulseloom.llm.common import BROADCAST_ROWS, SPACE_CHARS, materialize

#: Turns and characters of a conversation that one task may hold, turns that go through the layers at once.
LONG_TURNS, LONG_CHARS, TOGETHER = 4096, 1 << 24, 1 << 14
#: First characters of a text by which the turns of one number and role are dealt to tasks.
RANGE_CHARS = 256
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _readable(turns: DataFrame, present: Column | None) -> DataFrame:
    """The columns that the repair reads: who (a text for the id), conv_id, present, turn, role, text, code, truncated."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    end = F.rtrim(text, F.lit(SPACE_CHARS))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("who"),
        "conv_id", (F.lit(True) if present is None else present).alias("present"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), end.alias("end"),
    )
    initial = F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(0), F.lit("u"), F.lit(1), F.lit("a"), F.lit(2)), F.substring("role", 1, 1)), F.lit(3))
    cut = ~F.substring("end", -1, 1).isin(".", "!", "?")
    code = F.when(F.col("end") == "", grammar.DELETED).otherwise(initial + F.when(cut, 4).otherwise(0))
    return rows.withColumn("code", code.cast("int")).drop("end")


def _gaps(turns: list) -> int:
    some = {t for t in turns if t is not None}
    span = max(some) - min(some) if some else 0
    return span + 1 - len(some) if some and span < 1 << 63 else 0


def _lines(roles: list[str], texts: list[str], codes: list[int], audit: bytes) -> list[tuple[str, str]]:
    return [(role or roles[i], "" if i < 0 else texts[i]) for i, role in grammar.roles(audit, codes)]


class _Conversation:
    def __init__(self, who: str, id_):
        self.who, self.id, self.turns, self.roles, self.texts, self.codes, self.blank, self.duplicate = who, id_, [], [], [], [], 0, 0
        self.seen: set = set()

    def add(self, turn, role: str, text: str, code: int) -> None:
        if code == grammar.DELETED:
            self.blank += 1
        elif (role, text) in self.seen:
            self.duplicate += 1
            code = grammar.DELETED
        self.seen.add((role, text))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.codes.append(code)

    def illegal(self) -> int:
        return sum((a[:1], b[:1]) not in _LEGAL for a, b in zip(self.roles, self.roles[1:]))

    def report(self, cost: int, audit: bytes) -> tuple:
        lines = _lines(self.roles, self.texts, self.codes, audit)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode("utf-8", "surrogatepass")).hexdigest()
        truncated = sum(4 <= c < grammar.DELETED for c in self.codes)
        return self.id, _gaps(self.turns), self.blank, self.duplicate, truncated, self.illegal(), cost, audit.decode(), digest


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[list[_Conversation]]:
    """Whole conversations of rows in order, some at once."""
    names = ("who", "conv_id", "present", "turn", "role", "text", "code")
    done, now, turns = [], None, 0
    for batch in batches:
        for who, id_, present, turn, role, text, code in zip(*(batch.column(c).to_pylist() for c in names)):
            if now is None or who != now.who:
                if turns >= TOGETHER:
                    yield done
                    done, turns = [], 0
                now = _Conversation(who, id_)
                done.append(now)
            turns += 1
            if present:
                now.add(turn, role, text, code)
    yield done


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("who").sortWithinPartitions("who", F.asc_nulls_first("turn"), "role", "text")


def _short_reports(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    arrow = to_arrow_type(rows.schema["conv_id"].dataType)

    def of(batches):
        for some in _held(batches):
            found = [c.report(*x) for c, x in zip(some, grammar.repair([np.array(c.codes, np.uint8) for c in some]))]
            kinds = [arrow, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    return _in_order(rows).mapInArrow(of, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def _short_turns(rows: DataFrame) -> DataFrame:
    def of(batches):
        for some in _held(batches):
            out: list[list] = [[], [], [], []]
            for c, (_, audit) in zip(some, grammar.repair([np.array(c.codes, np.uint8) for c in some])):
                for n, (role, text) in enumerate(_lines(c.roles, c.texts, c.codes, audit)):
                    for column, value in zip(out, (c.who, n, role, text)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["who", "position", "role", "text"])

    return _in_order(rows).mapInArrow(of, "who string, position long, role string, text string")


# A long conversation: turns placed in order over all tasks, a piece for each task.


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct turns in order: who, part, place, at, turn, role, text, copies, code, blank. Later copies, which all go, are only counted."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("n"))
    turns = rows.groupBy("who", at.alias("at"), "role", "text", "code").agg(F.count("*").alias("copies"))
    turns = materialize(turns.withColumn("digest", F.sha2("text", 256)), "turns")
    first = turns.groupBy("who", "role", "digest").agg(F.min("at").alias("at")).withColumn("first", F.lit(True))
    turns = turns.join(first, ["who", "role", "digest", "at"], "left").withColumn("blank", F.col("code") == grammar.DELETED)
    turns = turns.withColumn("code", F.when(F.col("first").isNull(), grammar.DELETED).otherwise(F.col("code")))
    dealt = turns.repartitionByRange("who", "at", "role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("who", "at", "role", "text")
    dealt = dealt.select("who", "at", "role", "text", "copies", "code", "blank", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    return materialize(dealt, "placed")


PIECE = "who string, part int, places binary, codes binary, copies binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, deleted long, first string, last string"


def _piece(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    codes, copies, blank = (rows[c].to_numpy() for c in ("code", "copies", "blank"))
    initials = rows["initial"].to_pylist()
    illegal = sum((a, b) not in _LEGAL for a, b in zip(initials, initials[1:])) + int(sum((a, a) not in _LEGAL and n - 1 for a, n in zip(initials, copies.tolist())))
    gone = copies - (codes != grammar.DELETED)
    row = [
        rows["who"][0].as_py(), rows["part"][0].as_py(), rows["place"].to_numpy().astype("<i8").tobytes(), codes.astype(np.uint8).tobytes(), copies.astype("<i8").tobytes(), grammar.transfer(codes.astype(np.uint8)).ravel().tolist(),
        int(copies[blank].sum()), int(gone[~blank].sum()), int(((codes >= 4) & (codes < grammar.DELETED)).sum()), illegal, int((copies - 1).sum()), initials[0], initials[-1],
    ]
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.string(), pa.string()]
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names)


def _ends(pieces: pa.Table) -> pa.Table:
    """For each piece of a conversation what follows it costs, and in the first one's row the cost of the whole."""
    pieces = pieces.sort_by("part")
    ends, found = grammar.FINAL, []
    for matrix in pieces["costs"].to_pylist()[::-1]:
        found.append(ends.tolist())
        ends = grammar.before(np.array(matrix).reshape(4, 4), ends)
    cost = int(ends[0]) + grammar.DELETE * sum(pieces["deleted"].to_pylist())
    edges = list(zip(pieces["last"].to_pylist(), pieces["first"].to_pylist()[1:]))
    n = pieces.num_rows
    return pa.table({"who": pieces["who"], "part": pieces["part"], "ends": pa.array(found[::-1], pa.list_(pa.int64())), "cost": [cost] + [0] * (n - 1), "edges": [sum(e not in _LEGAL for e in edges)] + [0] * (n - 1)})


def _exits(batches):
    for batch in batches:
        found = [grammar.exits(np.frombuffer(c, np.uint8), _near(e)).tolist() for c, e in zip(batch.column("codes").to_pylist(), batch.column("ends").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("who"), batch.column("part"), pa.array(found, pa.list_(pa.int64()))], ["who", "part", "exits"])


def _near(ends: list[int]) -> np.ndarray:
    """Costs of what follows, less the least of them: only differences matter to what goes before."""
    return np.array(ends) - min(ends)


def _entries(pieces: pa.Table) -> pa.Table:
    pieces = pieces.sort_by("part")
    state, found = 0, []
    for step in pieces["exits"].to_pylist():
        found.append(state)
        state = step[state]
    missing = [0] * (len(found) - 1) + [int(grammar.FINAL[state] // grammar.INSERT)]
    return pa.table({"who": pieces["who"], "part": pieces["part"], "entry": found, "missing": missing})


_LETTERS = "who string, part int, letters string, place array<long>, seq array<long>, new array<boolean>, role array<string>"


def _letters(batches):
    """Each piece's part of the audit, and what is left of its turns and comes in, in order."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for r in batch.to_pylist():
            codes, copies, places = (np.frombuffer(r[c], k) for c, k in (("codes", np.uint8), ("copies", "<i8"), ("places", "<i8")))
            letters, turns, _ = grammar.audit(codes, _near(r["ends"]), r["entry"])
            # The last letter of a turn is its own; then its copies go.
            text = b"".join(bytes([x]) + b"D" * int(copies[t] - 1 if x != ord("I") else 0) for x, t in zip(letters.tolist(), turns.tolist()))
            state, place, new, role = r["entry"], [], [], []
            for (i, name), t in zip(grammar.roles(letters.tobytes(), codes.tolist(), state), turns[letters != ord("D")].tolist()):
                place.append(int(places[t]))
                new.append(i < 0)
                role.append(name)
            for k in range(r["missing"]):
                text += b"I"
                place.append(int(places[-1]))
                new.append(True)
                role.append(["user", "assistant"][(k + (r["missing"] == 1)) % 2])
            for column, value in zip(out, (r["who"], r["part"], text.decode(), place, list(range(len(place))), new, role)):
                column.append(value)
        kinds = [pa.string(), pa.int32(), pa.string(), *(pa.list_(x) for x in (pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in _LETTERS.split(", ")])


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces with their counts, their letters, and the repaired turns (who, part, seq, role, text) of long conversations."""
    placed = _placed(rows)
    narrow = placed.select("who", "part", "place", "code", "copies", "blank", F.substring("role", 1, 1).alias("initial"))
    pieces = materialize(narrow.groupBy("who", "part").applyInArrow(_piece, PIECE), "pieces")
    ends = pieces.select("who", "part", "costs", "deleted", "first", "last").groupBy("who").applyInArrow(_ends, "who string, part int, ends array<long>, cost long, edges long")
    pieces = materialize(pieces.join(ends, ["who", "part"]), "pieces")
    exits = pieces.select("who", "part", "codes", "ends").mapInArrow(_exits, "who string, part int, exits array<long>")
    entries = exits.groupBy("who").applyInArrow(_entries, "who string, part int, entry long, missing long")
    letters = pieces.select("who", "part", "places", "codes", "copies", "ends").join(entries, ["who", "part"]).mapInArrow(_letters, _LETTERS)
    letters = materialize(letters, "letters")
    edits = letters.select("who", "part", F.explode(F.arrays_zip("place", "seq", "new", "role")).alias("e")).select("who", "part", "e.*")
    turns = edits.join(placed.select("place", F.col("role").alias("own"), "text"), "place")
    turns = turns.select("who", "part", "seq", F.when(F.col("role") == "", F.col("own")).otherwise(F.col("role")).alias("role"), F.when(F.col("new"), "").otherwise(F.col("text")).alias("text"))
    return pieces, letters, turns


def _streamed(batches):
    """The digest of each conversation's lines, which come in order."""
    at, sha, out = None, None, []
    for batch in batches:
        for who, line in zip(batch.column("who").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist()):
            if who != at:
                if sha:
                    out.append((at, sha.hexdigest()))
                at, sha = who, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line)
    if sha:
        out.append((at, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["who", "repaired_sha256"])


def _long_reports(rows: DataFrame, kind: str) -> DataFrame:
    """The reports of long conversations, by who."""
    pieces, letters, turns = _long(rows.filter("present"))
    numbers = rows.filter("present AND turn IS NOT NULL").groupBy("who", "turn").agg(F.lit(1).alias("one")).groupBy("who").agg((F.try_subtract(F.max("turn"), F.min("turn")) - (F.count("*") - 1)).alias("gaps"))
    counts = pieces.groupBy("who").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")), (F.sum("illegal") + F.sum("edges")).alias("illegal"))
    audits = letters.groupBy("who").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    lines = turns.select("who", "part", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = lines.repartition("who").sortWithinPartitions("who", "part", "seq").mapInArrow(_streamed, "who string, repaired_sha256 string")
    out = rows.groupBy("who").agg(F.max("conv_id").alias("conv_id"))
    for more in (numbers, counts, audits, digests):
        out = out.join(more, "who", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of short conversations and those of long ones, if there are any."""
    sizes = rows.groupBy("who").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    long = materialize(sizes.filter((F.col("turns") > LONG_TURNS) | (F.col("chars") > LONG_CHARS)).select("who"), "long")
    n = long.count()
    if not n:
        return rows, None
    side = F.broadcast(long) if n <= BROADCAST_ROWS else long
    return rows.join(side, "who", "left_anti"), materialize(rows.join(side, "who", "left_semi"), "long-turns")


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults that the id and the number of a turn decide, for tests of the repair: conv_id, turn, role, text, present.

    By crc32(id:turn) % 20 a turn is 0 dropped (not present), 1 emptied, 2 without its . ! ?, 3 repeated, 4 said by the user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.col("fault") != 0, F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("present"))


def report(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) -> a row for each conversation: conv_id, gaps, counts of faults, cost, audit, repaired_sha256.

    present: rows where it is false only say that their conversation exists.
    """
    short, long = _split(_readable(turns, present))
    out = _short_reports(short)
    return out if long is None else out.unionByName(_long_reports(long, out.schema["conv_id"].dataType.simpleString()))


def repaired(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) -> the repaired ones: conv_id, position (from 0), role, text."""
    rows = _readable(turns, present)
    short, long = _split(rows)
    out = _short_turns(short)
    if long is not None:
        _, _, found = _long(long.filter("present"))
        # Positions by the turns of the parts before, so that no conversation is numbered by one task.
        before = found.groupBy("who", "part").agg(F.count("*").alias("n"))
        before = before.select("who", "part", (F.coalesce(F.sum("n").over(Window.partitionBy("who").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
        out = out.unionByName(found.join(before, ["who", "part"]).select("who", (F.col("seq") + F.col("offset")).alias("position"), "role", "text"))
    ids = turns.select("conv_id").distinct().withColumn("who", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    return out.join(ids, "who").select("conv_id", "position", "role", "text")
