"""Static binary-fuse filters over 64-bit keys, built and probed with numpy.

Three-wise binary fuse filter after Graf and Lemire (2022) with 16-bit
fingerprints: a key of the set always answers yes, any other one with
probability 2**-16. Construction peels all cells of degree one at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys, other for each seed."""
    x = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    segments: int
    cells: np.ndarray

    @staticmethod
    def _cells(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        low = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * segment)) ^ (h & low)
        return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """The filter of the distinct values among keys (uint64); of no keys, one that always says no."""
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        if n == 0:
            return cls(0, 0, 0, np.zeros(0, np.uint16))
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * factor / segment) - 2 + 1)
        for seed in range(1, 1000):
            if seed % 20 == 0:
                segments += max(1, segments // 8)
            h = mix(keys, seed)
            at = np.stack(cls._cells(h, segment, segments))
            order = cls._peel(at, (segments + 2) * segment)
            if order is not None:
                return cls(seed, segment, segments, cls._assign(order, at, cls._print(h), (segments + 2) * segment))
        raise RuntimeError("no seed gives a filter")

    @staticmethod
    def _peel(at: np.ndarray, size: int):
        """Rounds of (keys, their own cells), or None if some keys stay tangled."""
        n = at.shape[1]
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.bincount(at.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
        rounds, left, ready = [], n, np.flatnonzero(degree == 1)
        while len(ready):
            keys, first = np.unique(owner[ready], return_index=True)
            rounds.append((keys, ready[first]))
            left -= len(keys)
            touched = at[:, keys].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(owner, touched, np.tile(keys, 3))
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        return rounds if left == 0 else None

    @staticmethod
    def _assign(rounds, at: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray:
        cells = np.zeros(size, np.uint16)
        for keys, own in reversed(rounds):
            a, b, c = at[0, keys], at[1, keys], at[2, keys]
            cells[own] = prints[keys] ^ cells[a] ^ cells[b] ^ cells[c]  # the own cell is still 0
        return cells

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        if not len(self.cells):
            return np.zeros(len(keys), bool)
        h = mix(keys, self.seed)
        a, b, c = self._cells(h, self.segment, self.segments)
        return (self.cells[a] ^ self.cells[b] ^ self.cells[c]) == self._print(h)
