"""An FM-index over word symbols, in NumPy, for one shard of training text.

Symbol 0 is a separator that no pattern holds; every separator counts as a
symbol of its own, ordered by position.  Hence suffixes are told apart at the
first separator, and runs of words that occur in no pattern collapse into one.
"""

from __future__ import annotations

import numpy as np

#: Three positions have to fit into one 63-bit sort key.
MAX_SYMBOLS = 1 << 21


class BitRank:
    """Bits in 64-bit words with a running count of ones, for constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(self.n // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of each position ``i`` (0 to n)."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """A wavelet tree laid out by levels: symbols' ranks from one BitRank a bit."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level) & 1 == 1
            self.levels.append((level, BitRank(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        self.start = self._walk(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ranks, zeros in self.levels:
            ones = ranks.rank(i)
            i = np.where((symbols >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in front of its position ``i``."""
        return self._walk(symbols, i) - self.start[symbols]


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling over the groups that are still tied.

    Sort keys carry the position in their low bits, so each round is one plain
    sort of integers and ties up to a separator fall in order of position.
    """
    n = len(symbols)
    at = max(1, int(n - 1).bit_length())
    if 3 * at > 63 or at + bits > 63:
        raise ValueError(f"{n} symbols of {bits} bits are too many for one index")
    width = min((63 - at) // bits, n)
    key, tied = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(width):
        s = np.zeros(n, np.int64)
        s[: n - j] = symbols[j:]
        s[~tied] = 0
        key = key << bits | s
        tied &= s > 0
    position = np.arange(n)
    key = np.sort(key << at | position)
    order = key & ((1 << at) - 1)
    new = np.ones(n, bool)
    new[1:] = (key[1:] >> at) != (key[:-1] >> at)
    new |= ~tied[order]
    group = np.maximum.accumulate(np.where(new, position, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    alone = new.copy()
    alone[:-1] &= new[1:]
    left, step = np.flatnonzero(~alone), width
    while len(left):
        start = order[left]
        key = np.sort((group[left] << at | rank[np.minimum(start + step, n - 1)]) << at | start)
        start = key & ((1 << at) - 1)
        order[left] = start
        new = np.ones(len(left), bool)
        new[1:] = (key[1:] >> at) != (key[:-1] >> at)
        head = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        group[left] = head
        rank[start] = head
        alone = new.copy()
        alone[:-1] &= new[1:]
        left, step = left[~alone], step * 2
    return order


class FMIndex:
    """Count and locate fixed patterns in a sequence of symbols that ends in a 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample_every: int = 8) -> None:
        if not len(symbols) or symbols[-1]:
            raise ValueError("the sequence has to end in a separator")
        bits = max(1, int(sigma).bit_length())
        order = suffix_array(symbols, bits)
        self.n = len(symbols)
        self.bwt = symbols[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << bits))))
        self.ranks = WaveletMatrix(self.bwt, bits)
        keep = (self.bwt == 0) | (order % sample_every == 0)
        self.sampled, self.samples = BitRank(keep), order[keep]

    def _back(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.ranks.rank(symbols, i)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns by backward search; patterns stand at the right, 0 in front."""
        count, width = patterns.shape
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        live = np.arange(count)
        for j in range(width):
            live = live[(lengths[live] > j) & (low[live] < high[live])]
            if not len(live):
                break
            c = patterns[live, width - 1 - j]
            low[live], high[live] = self._back(c, low[live]), self._back(c, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every row in the ranges, walking back to a sampled suffix."""
        size = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        found = np.empty(len(rows), np.int64)
        for k in range(0, len(rows), part):
            todo, at = np.arange(k, min(k + part, len(rows))), rows[k : k + part].copy()
            steps = 0
            while len(todo):
                done = self.sampled.get(at)
                found[todo[done]] = self.samples[self.sampled.rank(at[done])] + steps
                todo, at = todo[~done], at[~done]
                at = self._back(self.bwt[at], at)
                steps += 1
        return which, found
