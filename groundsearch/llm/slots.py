"""A hash table of 64-bit keys in numpy arrays: open addressing, linear probing, at most half full."""

from __future__ import annotations

import numpy as np

FREE = np.uint64(2**64 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """The key 2^64 - 1 marks free slots and must not be used."""

    def __init__(self, room: int, dtype: type):
        self.bits = max(4, int(2 * room).bit_length())
        self.keys = np.full(1 << self.bits, FREE)
        self.values = np.zeros(1 << self.bits, dtype)

    @staticmethod
    def of(bits: int, keys: np.ndarray, values: np.ndarray) -> "Slots":
        out = object.__new__(Slots)
        out.bits, out.keys, out.values = bits, keys, values
        return out

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys."""
        at, left, last = self._first(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            trying = left[self.keys[at[left]] == FREE]
            self.keys[at[trying]] = keys[trying]  # of several for one slot the last stays
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & last

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys there are."""
        at, last = self._first(keys), (1 << self.bits) - 1
        now = self.keys[at]
        values, found = self.values[at], now == keys
        left = np.flatnonzero(~found)
        left = left[now[left] != FREE]
        while len(left):
            at[left] = (at[left] + 1) & last
            now = self.keys[at[left]]
            hit = now == keys[left]
            values[left[hit]] = self.values[at[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (now != FREE)]
        return values, found


class WordHasher:
    """Words of a byte buffer, between ASCII white space, and two 64-bit hashes of each, all at once."""

    ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self) -> None:
        self.powers = np.ones((4, 0), np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end, hash (never FREE), second hash. The buffer must end in white space."""
        inside = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13))))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        n = len(data)
        if self.powers.shape[1] < n:
            steps = [s for p in self.ODD for s in (p, pow(p, -1, 1 << 64))]
            self.powers = np.stack([np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n + n // 4, s, np.uint64), dtype=np.uint64))) for s in steps])
        values, out = data.astype(np.uint64) + np.uint64(1), []
        for up, down in (self.powers[:2], self.powers[2:]):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)))
            out.append((total[end] - total[begin]) * down[begin])
        out[0][out[0] == FREE] = 0
        return begin, end, out[0], out[1] ^ ((end - begin).astype(np.uint64) * MULTIPLIER)
