"""Elias-Fano coding of monotone sequences, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit of each word that has `rank` set bits below it."""
    place, rank = np.zeros(len(words), U64), rank.astype(U64)
    for step in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count((words >> place) & U64((1 << step) - 1)).astype(U64)
        go = rank >= below
        rank = np.where(go, rank - below, rank)
        place = np.where(go, place + U64(step), place)
    return place.astype(np.int64)


class EliasFano:
    """n non-decreasing numbers: `width` low bits each, and the rest in unary, with a count of bits before each word."""

    FIELDS = ("low", "high", "ones")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=U64)[None, :]) & U64(1) if width else np.zeros((n, 0), U64)
        low = _packed(bits.astype(np.uint8).ravel())
        places = (values >> U64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(places[-1]) if n else 0) + 2, np.uint8)
        unary[places] = 1
        high = _packed(unary)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, width, low, high, ones.astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        out = self.low[word] >> shift
        over = shift + U64(self.width) > U64(64)
        if over.any():
            out[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return (out & U64((1 << self.width) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * word + _in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.width) | self._low(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below `high`."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        k = high[some] - 1
        word = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        beyond = k >= self.zeros[-1]
        place = 64 * word + _in_word(~self.high[word], k - self.zeros[word])
        out[some] = np.where(beyond, self.n, place - k)
        return out

    def find(self, target: np.ndarray) -> np.ndarray:
        """The index of each target, or -1: successor search among the numbers that share its high part."""
        target = np.asarray(target, np.int64)
        high, low = target >> self.width, target & ((1 << self.width) - 1)
        at, end = np.split(np.minimum(self._before(np.concatenate([high, high + 1])), self.n), 2)
        out = np.full(len(target), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            middle = (at[left] + end[left]) >> 1
            own = self._low(middle)
            same = own == low[left]
            out[left[same]] = middle[same]
            at[left] = np.where(own < low[left], middle + 1, at[left])
            end[left] = np.where(own < low[left], end[left], middle)
            left = left[~same & (at[left] < end[left])]
        return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, the first the lowest, and a word more."""
    data = np.packbits(bits, bitorder="little").tobytes()
    return np.frombuffer(data + bytes(16 - len(data) % 8), U64)
