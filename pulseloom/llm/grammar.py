"""Cheapest edits that make turns follow ``(s?(ua)+)?``, by cost layers of reachable grammar states.

States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept. A turn
has a code: its role's initial (0 s, 1 u, 2 a, 3 another), 4 more if its text is
cut short, DELETED if it has to go. For each cost 0, 1, 2, ... a layer holds for
every turn the bitset of states from which the rest can be repaired at exactly
that cost. Deletions, inserts, new roles and cut texts come from earlier layers;
kept turns run through a layer from its end. The first layer whose beginning
holds the entry state gives the cost, and a walk along the bits, which takes the
least letter that stays in them, the least audit.

Many conversations go through the layers at once. A long one is cut into blocks
of TURNS: a block's layers for each exit state give a matrix of costs, matrices
combine, and every block then has the costs of what follows it as its end.
"""

from __future__ import annotations

import numpy as np

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Codes of a turn that has to be deleted, and of the filling behind a short block.
DELETED, FILL = 8, 9
#: Turns of a block; blocks whose layers are held at once.
TURNS, BLOCKS = 32, 2048
#: Costs of what is missing at the end: nothing, user and assistant, assistant, nothing.
FINAL = np.array([0, 2 * INSERT, INSERT, 0])
NEVER = 1 << 40
NEXT = np.array([2, 2, 3, 2])  # the state behind a role that is free to choose
_STEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by initial and state
_LARGEST = REROLE + CUT


def _before(step: np.ndarray) -> np.ndarray:
    """For each bitset the states that a step leads into it."""
    masks = np.arange(16)
    return sum(((masks >> to & 1) << state if to >= 0 else 0 * masks) for state, to in enumerate(step)).astype(np.uint8)


_ANY = _before(NEXT)
_NONE = np.zeros(16, np.uint8)
# For each code and bitset: the states from which keeping the turn, without and with a cut text, or giving it a role leads into it.
_KEPT = np.array([*(_before(s) for s in _STEP), *[_NONE] * 5, np.arange(16, dtype=np.uint8)])
_KEPT_CUT = np.array([*[_NONE] * 4, *(_before(s) for s in _STEP), _NONE, _NONE])
_ROLE = np.array([*[_ANY] * 4, *[_NONE] * 6])
_ROLE_CUT = np.array([*[_NONE] * 4, *[_ANY] * 4, _NONE, _NONE])


def layers(codes: np.ndarray, ends: np.ndarray, entry: int | None = None) -> np.ndarray:
    """Bitsets [cost + 6, turn, block] for codes [block, turn] and the costs [block, state] of what follows.

    With an entry state the layers stop where all blocks hold it at their
    beginning; else they hold all states that can be at the beginning at all.
    """
    n, turns = codes.shape
    by_turn = np.ascontiguousarray(codes.T)
    real = (by_turn != FILL).astype(np.uint8) * np.uint8(15)
    known = ends[ends < NEVER]
    most = DELETE * turns + 2 * INSERT + (int(known.max()) if len(known) else 0)
    out = np.zeros((_LARGEST + min(most, 64) + 1, turns + 1, n), np.uint8)
    missing = np.ones(n, bool)
    for cost in range(most + 1):
        at = cost + _LARGEST
        if at == len(out):
            out = np.concatenate((out, np.zeros_like(out)))
        layer = out[at]
        layer[turns] = ((ends == cost) << np.arange(4)).sum(1)
        base = out[at - DELETE, 1:] | _ANY[out[at - INSERT, :-1]]
        base &= real
        base |= _KEPT_CUT[by_turn, out[at - CUT, 1:]] | _ROLE[by_turn, out[at - REROLE, 1:]] | _ROLE_CUT[by_turn, out[at - REROLE - CUT, 1:]]
        for i in range(turns - 1, -1, -1):
            np.bitwise_or(base[i], _KEPT[by_turn[i], layer[i + 1]], out=layer[i])
        if entry is not None:
            missing &= (layer[0] >> entry & 1) == 0
            if not missing.any():
                return out[: at + 1]
    return out[: most + _LARGEST + 1]


def costs(found: np.ndarray) -> np.ndarray:
    """[block, state]: the first layer that holds a state at the beginning of a block."""
    first = (found[_LARGEST:, 0, :, None] >> np.arange(4) & 1).astype(bool)
    return np.where(first.any(0), first.argmax(0), NEVER)


def trace(codes: np.ndarray, found: np.ndarray, block: np.ndarray, state: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least audit of some blocks from a state at a cost: letters [step, block] (0 for none), their turns, and the exit states."""
    state, at = state.copy(), cost + _LARGEST
    letters, turns = [], []
    holds = lambda at, i, s: found[np.maximum(at, 0), i, block] >> s & 1 == 1
    for i in range(codes.shape[1]):
        code = codes[block, i]
        open_ = np.ones(len(block), bool)
        while open_.any():
            letter = np.zeros(len(block), np.uint8)
            free, cut = code < DELETED, np.where((code >= 4) & (code < DELETED), CUT, 0)
            kept = np.where(code == FILL, state, _STEP[np.where(free, code % 4, 3), state])
            keep = (kept >= 0) & (free | (code == FILL)) & holds(at - cut, i + 1, np.maximum(kept, 0))
            role = free & holds(at - REROLE - cut, i + 1, NEXT[state])
            insert = (code != FILL) & holds(at - INSERT, i, NEXT[state])
            delete = (code != FILL) & holds(at - DELETE, i + 1, state)
            letter[role], letter[keep], letter[insert], letter[delete] = ord("R"), ord("K"), ord("I"), ord("D")
            letter[~open_] = 0
            spent = np.select([letter == ord("D"), letter == ord("I"), letter == ord("R"), letter == ord("K")], [DELETE, INSERT, REROLE + cut, cut], 0)
            state = np.select([(letter == ord("I")) | (letter == ord("R")), letter == ord("K")], [NEXT[state], kept], state)
            at = at - spent
            open_ &= letter == ord("I")
            letters.append(np.where(code == FILL, 0, letter).astype(np.uint8))
            turns.append(i)
    shape = (len(letters), len(block))
    return np.array(letters, np.uint8).reshape(shape), np.array(turns), state


def _blocks(codes: np.ndarray) -> np.ndarray:
    n = -(-len(codes) // TURNS)
    out = np.full(n * TURNS, FILL, np.uint8)
    out[: len(codes)] = codes
    return out.reshape(n, TURNS)


def _parts(n: int):
    return ((at, min(at + BLOCKS, n)) for at in range(0, n, BLOCKS))


def _transfers(blocks: np.ndarray) -> np.ndarray:
    """[block, entry, exit]: the least cost from one state to another."""
    out = np.empty((len(blocks), 4, 4), np.int64)
    for a, b in _parts(len(blocks)):
        for exit_ in range(4):
            ends = np.full((b - a, 4), NEVER)
            ends[:, exit_] = 0
            out[a:b, :, exit_] = costs(layers(blocks[a:b], ends))
    return out


def transfer(codes: np.ndarray) -> np.ndarray:
    """[entry, exit]: the least cost of all turns from one state to another."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for block in _transfers(_blocks(codes)):
        total = np.minimum((total[:, :, None] + block[None]).min(1), NEVER)
    return total


def before(matrix: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The costs from each state on, where a matrix of costs goes before what costs ``ends``."""
    return (matrix + ends[None, :]).min(1)


def _walks(codes: np.ndarray, ends: np.ndarray):
    """The blocks of some turns, and part by part what a trace from each of the four states gives."""
    blocks = _blocks(codes)
    follow = np.empty((len(blocks), 4), np.int64)
    for i, matrix in zip(range(len(blocks) - 1, -1, -1), _transfers(blocks)[::-1]):
        follow[i] = ends - ends.min()
        ends = before(matrix, ends)
    for a, b in _parts(len(blocks)):
        found = layers(blocks[a:b], follow[a:b])
        first = costs(found)
        block = np.repeat(np.arange(b - a), 4)
        yield trace(blocks[a:b], found, block, np.tile(np.arange(4), b - a), np.minimum(first, len(found)).ravel())


def exits(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each entry state the exit state of the least audit of some turns, which what costs ``ends`` follows."""
    at = np.arange(4)
    for _, _, exit_ in _walks(codes, ends):
        for step in exit_.reshape(-1, 4):
            at = step[at]
    return at


def audit(codes: np.ndarray, ends: np.ndarray, entry: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The least audit of some turns, which what costs ``ends`` follows: letters, each one's turn, and the exit state."""
    letters, turns, state, offset = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], entry, 0
    for found, steps, exit_ in _walks(codes, ends):
        found = found.reshape(len(steps), -1, 4)
        for i, step in enumerate(exit_.reshape(-1, 4)):
            mine = found[:, i, state]
            letters.append(mine[mine > 0])
            turns.append(steps[mine > 0] + offset)
            offset += TURNS
            state = int(step[state])
    return np.concatenate(letters), np.concatenate(turns), state


def repair(conversations: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """The least cost and the least audit of each conversation's codes."""
    out: list = [(0, b"")] * len(conversations)
    width = 4
    sizes = np.array([len(c) for c in conversations])
    while width <= TURNS:
        some = np.flatnonzero((sizes > width // 2) & (sizes <= width)) if width > 4 else np.flatnonzero((sizes > 0) & (sizes <= 4))
        for a in range(0, len(some), BLOCKS):
            chosen = some[a : a + BLOCKS]
            codes = np.full((len(chosen), width), FILL, np.uint8)
            for row, i in enumerate(chosen):
                codes[row, : sizes[i]] = conversations[i]
            found = layers(codes, np.tile(FINAL, (len(chosen), 1)), 0)
            cost = costs(found)[:, 0]
            letters, _, exit_ = trace(codes, found, np.arange(len(chosen)), np.zeros(len(chosen), np.int64), cost)
            for row, i in enumerate(chosen):
                mine = letters[:, row]
                out[i] = (int(cost[row]), mine[mine > 0].tobytes() + b"I" * int(FINAL[exit_[row]] // INSERT))
        width *= 2
    for i in np.flatnonzero(sizes > TURNS):
        codes = conversations[i]
        letters, _, state = audit(codes, FINAL)
        out[i] = (int(before(transfer(codes), FINAL)[0]), letters.tobytes() + b"I" * int(FINAL[state] // INSERT))
    return out


def roles(letters: bytes, codes: list[int], entry: int = 0) -> list[tuple[int, str]]:
    """What an audit makes of some turns: for each one that stays or comes in, its turn (-1 for a new one) and its new role ('' for its own)."""
    state, i, out = entry, 0, []
    for letter in letters:
        if letter == ord("K"):
            state = int(_STEP[codes[i] % 4, state])
            out.append((i, ""))
        elif letter != ord("D"):
            state = int(NEXT[state])
            out.append((i if letter == ord("R") else -1, "user" if state == 2 else "assistant"))
        i += letter != ord("I")
    return out
