"""The repair of conversations against one that holds them whole and searches all edits, short ones and long ones dealt over tasks."""

import hashlib
import random
import re
import zlib

import pytest

from pulseloom.llm import conversations
from tests.llm.test_grammar import slow

SCHEMA = "conv_id long, turn long, role string, text string, who string, part int, code string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def made(seed=1, n=40, turns=14):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, turns)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sys", "usher"])
            text = r.choice(["Hi.", "Yes!", "what?  \n", "cut short", "", " \t", None, "é ü.", "no\nend.\x0b", f"text {r.randrange(9)}.", f"more {r.randrange(99)}?"])
            rows.append((c, r.choice([t, t, t, t + 1, None, 3 * t]), role, text))
    rows += [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes."), (900, -(1 << 63), "user", "A."), (900, (1 << 63) - 1, "assistant", "B.")]
    rows += [(901, 1, "user", "word " * 40_000 + "end."), (901, 2, "assistant", "x" * 70_000)]
    return rows


def expected(rows, present=None):
    """{conv_id: report}, of rows (conv_id, turn, role, text) and whether each is there."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = [(r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for i, r in enumerate(rows) if r[0] == c and (present is None or present[i])]
        mine.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        codes, seen, faults = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            chars = WORD.findall(text)
            code = "sua".find(role[:1]) % 4 if role else 3
            if not chars:
                faults["blank"] += 1
                code = 8
            elif (role, text) in seen:
                faults["duplicate"] += 1
                code = 8
            elif chars[-1] not in ".!?":
                faults["truncated"] += 1
                code += 4
            seen.add((role, text))
            codes.append(code)
        cost, audit = slow(codes)
        lines, i, count = [], 0, 0
        first_kept = bool(audit.replace("D", "")) and [x for x in zip(audit.replace("I", ""), mine) if x[0] != "D"][:1]
        offset = 1 if first_kept and audit.replace("D", "")[0] == "K" and first_kept[0][1][2][:1] == "s" else 0
        for letter in audit:
            if letter == "I" or letter == "R":
                role = ["user", "assistant"][(count - offset) % 2]
                lines.append(f"{role}:{mine[i][3] if letter == 'R' else ''}")
                count += 1
            elif letter == "K":
                lines.append(f"{mine[i][2]}:{mine[i][3]}")
                count += 1
            i += letter != "I"
        numbers = {t for known, t, _, _ in mine if known}
        span = max(numbers) - min(numbers) if numbers else 0
        gaps = span + 1 - len(numbers) if numbers and span < 1 << 63 else 0
        roles = [x[2][:1] for x in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[c] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(4)


def reported(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("long", [1 << 30, 5, 0])
def test_report_and_turns(spark, monkeypatch, long):
    """All conversations short, some long, all long."""
    monkeypatch.setattr(conversations, "LONG_TURNS", long)
    rows = made()
    want = expected(rows)
    turns = frame(spark, rows)
    assert reported(conversations.report(turns)) == {c: x[:-1] for c, x in want.items()}
    lines = {c: [] for c in want}
    for r in conversations.repaired(turns).orderBy("conv_id", "position").collect():
        assert r["position"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert lines == {c: x[-1] for c, x in want.items()}


def test_a_very_long_conversation_of_few_texts(spark):
    """More turns than a task may hold, of which many are equal, in several tasks' ranges."""
    r = random.Random(4)
    rows = [(1, r.choice([t, t, None]), r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["Ok.", f"text {t}.", f"cut {t}", ""])) for t in range(3000)]
    rows += [(1, 5000, "user", "Again and again.")] * 2500 + [(2, 1, "user", "Short.")]
    assert len(rows) > conversations.LONG_TURNS
    want = expected(rows)
    assert reported(conversations.report(frame(spark, rows))) == {c: x[:-1] for c, x in want.items()}


@pytest.mark.parametrize("long", [1 << 30, 0])
def test_damage(spark, monkeypatch, long):
    monkeypatch.setattr(conversations, "LONG_TURNS", long)
    rows, broken, present = made(7), [], []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        broken += [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        present += [fault != 0] * (2 if fault == 3 else 1)
    assert not all(present)
    damaged = conversations.damaged(frame(spark, rows))
    got = conversations.report(damaged, damaged["present"])
    assert reported(got) == {c: x[:-1] for c, x in expected(broken, present).items()}


def test_empty(spark):
    assert conversations.report(frame(spark, [])).count() == 0 and conversations.repaired(frame(spark, [])).count() == 0
