"""Elias-Fano sequences and an n-gram trie over them, in memory-mapped arrays.

A level of the trie holds, for every context, its successors in ascending order. The successors of all contexts lie in
one monotone sequence (each context's values are shifted by the last value before it), and the contexts' ranges are
monotone pointers; both are Elias-Fano coded. Probabilities are quantised to 16 bits. A successor is searched relative
to its context: only within the range the pointers give.
"""

from __future__ import annotations

import mmap
import os

import numpy as np


def mapped(values: np.ndarray, path: str | None = None) -> np.ndarray:
    """The array in a memory map: of the file at ``path``, or an anonymous one, which goes with the process."""
    size = max(1, values.nbytes)
    if path is None:
        out = np.frombuffer(mmap.mmap(-1, size), values.dtype, len(values))
        out[:] = values
        return out
    values.tofile(path)
    if not len(values):
        return values
    return np.memmap(path, values.dtype, "r", shape=values.shape)


_ONE_BIT, _TWO_BITS, _FOUR_BITS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_EACH_BYTE, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Of each byte and rank, eight ranks a byte, the place of the bit with that rank.
_BIT_PLACE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)]).reshape(-1)


class EliasFano:
    """A monotone sequence of integers below ``universe``: the low bits of each, packed, and the high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int, path: str | None = None):
        n = len(values)
        self.n = n
        self.low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        place = lambda name: None if path is None else f"{path}.{name}"
        self.low = mapped(self._packed(values & np.uint64((1 << self.low_bits) - 1)), place("low"))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        ones = high + np.arange(n)
        bits = np.zeros((int(ones[-1]) // 64 + 2) * 64 if n else 64, np.uint8)
        bits[ones] = 1
        packed = np.packbits(bits, bitorder="little").view(np.uint64)
        self.high = mapped(packed, place("high"))
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        self.ranks = mapped(counts, place("ranks"))  # ones before each word

    def _packed(self, low: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(1, np.uint64)
        at = np.arange(len(low), dtype=np.int64) * self.low_bits
        out = np.zeros(int(len(low) * self.low_bits) // 64 + 2, np.uint64)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, low << shift)
        spill = np.flatnonzero((at & 63) + self.low_bits > 64)
        np.bitwise_or.at(out, word[spill] + 1, low[spill] >> (np.uint64(64) - shift[spill]))
        return out

    def _select(self, rank: np.ndarray) -> np.ndarray:
        """Where the ``rank``-th one stands: the word by the ranks, the byte by sums in all bytes at once, the bit by
        table."""
        word = np.searchsorted(self.ranks, rank, "right") - 1
        left = (rank - self.ranks[word]).astype(np.uint64)
        bits = self.high[word]
        sums = bits - ((bits >> np.uint64(1)) & _ONE_BIT)
        sums = (sums & _TWO_BITS) + ((sums >> np.uint64(2)) & _TWO_BITS)
        sums = ((sums + (sums >> np.uint64(4))) & _FOUR_BITS) * _EACH_BYTE  # ones up to each byte's end
        passed = ((left * _EACH_BYTE | _TOP) - sums & _TOP) >> np.uint64(7)  # bytes that end at or before the rank
        byte = (passed * _EACH_BYTE >> np.uint64(56)) << np.uint64(3)
        before = (sums << np.uint64(8)) >> byte & np.uint64(255)
        inside = (bits >> byte) & np.uint64(255)
        return word * 64 + byte.astype(np.int64) + _BIT_PLACE[(inside << np.uint64(3) | (left - before)).view(np.int64)]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        at = np.asarray(at, np.int64)
        high = (self._select(at) - at).astype(np.uint64)
        if not self.low_bits:
            return high.astype(np.int64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        low = self.low[word] >> shift
        over = (bit & 63) + self.low_bits > 64
        low = np.where(over, low | (self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))), low)
        return ((high << np.uint64(self.low_bits)) | (low & np.uint64((1 << self.low_bits) - 1))).astype(np.int64)

    def successor(self, least: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each range of places the first with a value of ``least`` or more (``end`` if none), and its value."""
        lo, hi = begin.astype(np.int64).copy(), end.astype(np.int64).copy()
        value = np.full(len(lo), -1, np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            found = self.get(middle)
            small = found < least[open_]
            lo[open_[small]] = middle[small] + 1
            large = open_[~small]
            hi[large], value[large] = middle[~small], found[~small]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, value

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ranks.nbytes


#: Steps of the quantiser: log10 probabilities from 0 down to LOWEST on an even grid of 16-bit codes.
LOWEST = -20.0


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logs, LOWEST, 0) * (65535 / LOWEST)).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (LOWEST / 65535)


class Level:
    """The n-grams of one order, sorted by context and word: contexts are places in the level above. Each has a log10
    probability and, unless it is the last level, a log10 backoff weight as a context."""

    def __init__(self, above: int, contexts: np.ndarray, words: np.ndarray, logs: np.ndarray, backoffs: np.ndarray | None, place):
        pointers = np.searchsorted(contexts, np.arange(above + 1))
        self.pointers = EliasFano(pointers, len(contexts) + 1, place("pointers"))
        # each context's words come after the last value before them
        used = np.flatnonzero(np.diff(pointers))
        last = words[pointers[used + 1] - 1] + 1 if len(used) else np.empty(0, np.int64)
        shifts = np.concatenate([[0], np.cumsum(last)])
        self.successors = EliasFano(words + np.repeat(shifts[:-1], np.diff(pointers)[used]), int(shifts[-1]) + 1, place("successors"))
        self.logs = mapped(quantised(logs), place("logs"))
        self.backoffs = None if backoffs is None else mapped(quantised(backoffs), place("backoffs"))

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each n-gram, -1 where there is none: the successor is searched in its context's range only."""
        out = np.full(len(words), -1, np.int64)
        if not self.successors.n or not len(words):
            return out
        # of each context, where its range begins and what its words are shifted by: read once for all its n-grams
        bounds = self.pointers.get(np.arange(self.pointers.n))
        used = np.flatnonzero(np.diff(bounds))
        shifts = np.zeros(self.pointers.n, np.int64)
        later = used[bounds[used] > 0]
        shifts[later] = self.successors.get(bounds[later] - 1) + 1
        begin, end = bounds[contexts], bounds[contexts + 1]
        some = np.flatnonzero(end > begin)
        begin, end = begin[some], end[some]
        sought = words[some] + shifts[contexts[some]]
        at, value = self.successors.successor(sought, begin, end)
        hit = value == sought
        out[some[hit]] = at[hit]
        return out

    @property
    def nbytes(self) -> int:
        return self.pointers.nbytes + self.successors.nbytes + self.logs.nbytes + (0 if self.backoffs is None else self.backoffs.nbytes)


class Trie:
    """Words 0 .. m - 1 with a log10 probability and, as contexts, a log10 backoff weight each, and levels of longer
    n-grams: (contexts, words, log10 probabilities, backoff weights or None), sorted by context and word.

    With ``folder`` the arrays are files there, mapped into memory; else anonymous maps.
    """

    def __init__(self, word_logs: np.ndarray, backoffs: np.ndarray, levels: list[tuple], folder: str | None = None):
        place = lambda level: lambda name: None if folder is None else os.path.join(folder, f"{name}{level}")
        self.unigrams = mapped(quantised(word_logs), place(1)("logs"))
        self.backoffs = mapped(quantised(backoffs), place(1)("backoffs"))
        self.levels: list[Level] = []
        above = len(word_logs)
        for order, level in enumerate(levels, 2):
            self.levels.append(Level(above, *level, place(order)))
            above = len(level[0])

    def unigram(self, words: np.ndarray) -> np.ndarray:
        return restored(self.unigrams[words])

    def pair(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word after a word, and the pair's place in its level (-1: none)."""
        at = self.levels[0].find(contexts, words)
        return np.where(at >= 0, restored(self.levels[0].logs[at]) if self.levels[0].successors.n else 0.0, self.unigram(words) + restored(self.backoffs[contexts])), at

    def triple(self, pairs: np.ndarray, words: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """log10 probability of each word after a pair (by place, -1: none), given that after its last word."""
        out = shorter.copy()
        within = np.flatnonzero(pairs >= 0)
        context = pairs[within]
        at = self.levels[1].find(context, words[within])
        has = at >= 0
        out[within] += np.where(has, 0.0, restored(self.levels[0].backoffs[context]))
        out[within[has]] = restored(self.levels[1].logs[at[has]])
        return out

    @property
    def nbytes(self) -> int:
        return self.unigrams.nbytes + self.backoffs.nbytes + sum(level.nbytes for level in self.levels)
