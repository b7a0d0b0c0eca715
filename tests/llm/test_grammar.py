"""Cost layers against a shortest-path search over whole conversations that keeps the least audit."""

import random

import numpy as np
import pytest

from pulseloom.llm import grammar

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def slow(codes):
    """The least (cost, audit) by all edits from each grammar state, turn by turn."""
    best = {"": (0, "")}

    def with_inserts(found):
        for _ in range(3):
            for state, (cost, audit) in list(found.items()):
                for role in "ua":
                    to = STEPS.get((state, role))
                    if to and (cost + 3, audit + "I") < found.get(to, (1 << 30, "")):
                        found[to] = (cost + 3, audit + "I")
        return found

    for code in codes:
        new = {}
        for state, (cost, audit) in with_inserts(best).items():
            ways = [(state, cost + 4, "D")]
            if code < 8:
                cut = 3 if code >= 4 else 0
                own = "sua-"[code % 4]
                ways += [(STEPS[state, own], cost + cut, "K")] if (state, own) in STEPS else []
                ways += [(STEPS[state, r], cost + cut + 3, "R") for r in "ua" if (state, r) in STEPS]
            for to, c, letter in ways:
                new[to] = min(new.get(to, (1 << 30, "")), (c, audit + letter))
        best = new
    best = with_inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def random_codes(r, n):
    return np.array([r.choice([0, 1, 2, 1, 2, 1, 2, 3, 4, 5, 6, 5, 6, 7, 8, 8]) for _ in range(n)], np.uint8)


def test_short_conversations():
    r = random.Random(1)
    made = [random_codes(r, r.choice([0, 1, 1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 25, 32])) for _ in range(1500)]
    for codes, (cost, audit) in zip(made, grammar.repair(made)):
        assert (cost, audit.decode()) == slow(codes.tolist()), codes


@pytest.mark.parametrize("seed", range(6))
def test_long_conversations_by_blocks(seed, monkeypatch):
    monkeypatch.setattr(grammar, "TURNS", 3 if seed % 2 else 32)
    monkeypatch.setattr(grammar, "BLOCKS", 4 if seed % 3 else 2048)
    r = random.Random(seed)
    made = [random_codes(r, r.randint(33, 150)) for _ in range(12)]
    for codes, (cost, audit) in zip(made, grammar.repair(made)):
        assert (cost, audit.decode()) == slow(codes.tolist())


def test_pieces_of_one_conversation():
    """Pieces by themselves, with the costs of what follows and the state that they begin in, give the whole audit."""
    r = random.Random(9)
    for _ in range(20):
        codes = random_codes(r, 140)
        cuts = [0, *sorted(r.sample(range(1, 140), 3)), 140]
        pieces = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        ends, follow = grammar.FINAL, []
        for p in pieces[::-1]:
            follow.insert(0, ends)
            ends = grammar.before(grammar.transfer(p), ends)
        state, letters = 0, b""
        for p, e in zip(pieces, follow):
            mine, turns, out = grammar.audit(p, e, state)
            assert out == grammar.exits(p, e)[state] and len(turns) == len(mine)
            letters, state = letters + mine.tobytes(), out
        letters += b"I" * int(grammar.FINAL[state] // 3)
        assert (int(ends[0]), letters.decode()) == slow(codes.tolist())


def test_roles():
    codes = [0, 1, 8, 6, 3]
    (cost, audit), = grammar.repair([np.array(codes, np.uint8)])
    assert (cost, audit) == (4 + 4 + 3, b"KKDDR")
    assert grammar.roles(audit, codes) == [(0, ""), (1, ""), (4, "assistant")]
    assert grammar.roles(b"RI", [3]) == [(0, "user"), (-1, "assistant")]
