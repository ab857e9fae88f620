"""Counts in a Bloom filter: a key is held together with each level up to that of its count, and levels grow with the count's logarithm."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _spread(keys: np.ndarray, level: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each key at a level, and the bits that it has in its word."""
    h = mixed(keys + np.uint64(_STEP * level % (1 << 64)))
    bits, mask, bit = mixed(h ^ _MIX[0]), np.zeros(len(keys), np.uint64), np.empty(len(keys), np.uint64)
    for i in range(hashes):
        np.bitwise_and(bits, np.uint64(63), out=bit)
        np.left_shift(np.uint64(1), bit, out=bit)
        mask |= bit
        if i % 10 < 9:
            bits >>= np.uint64(6)
        else:
            bits = mixed(h + np.uint64(i))
    return h >> np.uint64(32), mask


def level_starts(growth: float) -> np.ndarray:
    """The least count of each level from 1 on: 1, 2, 3, then each by growth more than the one before."""
    starts = [1]
    while starts[-1] < 1 << 61:
        starts.append(max(starts[-1] + 1, int(starts[-1] * growth)))
    return np.array(starts, np.int64)


@dataclass
class Levels:
    growth: float

    def __post_init__(self) -> None:
        self.starts = level_starts(self.growth)
        #: What a level stands for: the middle of its counts; 0 for none.
        self.middles = np.concatenate([[0.0], (self.starts[:-1] + self.starts[1:] - 1) / 2])

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, counts, side="right")


@dataclass
class CountFilter:
    """words of 64 bits. A key at a level has `hashes` bits of one word, so a probe reads one place in memory. A key's level is never
    found lower than it is; it is found higher with a chance that falls with hashes: 0.6 % at 6, with 14.7 bits for each key and level."""

    hashes: int
    words: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, levels: np.ndarray, hashes: int) -> CountFilter:
        """A filter of (key, 1), ..., (key, level). keys are distinct. As all bits of a key are in one word, more bits need more room each."""
        out = CountFilter(hashes, np.zeros(max(1, int(np.ceil(levels.sum() * hashes * (2.2 + hashes / 24) / 64))), np.uint64))
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = (keys, levels) if level == 1 else (keys[levels >= level], levels[levels >= level])
            at, mask = _spread(keys, level, hashes)
            np.bitwise_or.at(out.words, out._place(at), mask)
        return out

    def _place(self, at: np.ndarray) -> np.ndarray:
        return (at * np.uint64(len(self.words)) >> np.uint64(32)).astype(np.int64)

    def levels(self, keys: np.ndarray, starts: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
        """The level of each key, 0 if it isn't held: probed from 1 on until a level is missing. starts and sizes: of each key's own
        words, where several filters lie behind one another; they are probed together."""
        found, left, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(keys) and level < 255:
            level += 1
            at, mask = _spread(keys, level, self.hashes)
            place = self._place(at) if sizes is None else starts + (at * sizes >> np.uint64(32)).astype(np.int64)
            held = np.flatnonzero((self.words[place] & mask) == mask)
            keys, left = keys[held], left[held]
            if sizes is not None:
                starts, sizes = starts[held], sizes[held]
            found[left] = level
        return found
