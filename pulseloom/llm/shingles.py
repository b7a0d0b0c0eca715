"""Word and character shingles of many texts at once, as 64-bit hashes, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in chunks of about so many bytes; a longer one is cut at white space.
CHUNK = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20_240_229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i + 1]], and where each text's words start."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACES[data]
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), np.searchsorted(start, offsets)


def _cut(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end before white space."""
    while len(data) > CHUNK:
        at = CHUNK
        while at < len(data):
            space = np.flatnonzero(SPACES[data[at : at + CHUNK]])
            if len(space):
                at += int(space[0])
                break
            at += CHUNK
        yield data[:at]
        data = data[at:]
    yield data


def texts_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text (no nulls) the hashes of its words, in order."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if to == at + 1 and len(part) > CHUNK:
            yield np.concatenate([hash_words(p, np.array([0, len(p)]))[0] for p in _cut(part)])
        else:
            hashes, where = hash_words(part, offsets[at : to + 1] - offsets[at])
            for i in range(to - at):
                yield hashes[where[i] : where[i + 1]]
        at = to


def word_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; of a shorter text, the one of all its words; of no words, none."""
    size = min(n, len(words))
    if not size:
        return words
    total = words[: len(words) - size + 1] * _PLACE[0]
    for j in range(1, size):
        total = total + words[j : len(words) - size + 1 + j] * _PLACE[j]
    return mix(total + np.uint64(size))


def char_shingles(text: str, n: int) -> np.ndarray:
    """Hashes of the runs of n characters; of a shorter text, the one of all of it; of an empty one, none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return word_shingles(mix(points + np.uint64(1)), n)


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and how often each occurs."""
    x = np.sort(shingles)
    if not len(x):
        return x, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[at], np.diff(np.append(at, len(x)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger ones; keys are in order. 0 for two empty ones."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    same = kb[at] == ka
    both = float(np.minimum(wa[same], wb[at[same]]).sum())
    return both / (float(wa.sum()) + float(wb.sum()) - both)
