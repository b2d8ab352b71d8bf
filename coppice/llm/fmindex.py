"""A compressed full-text index over sequences of word numbers, searched backwards.

The Burrows-Wheeler transform of the concatenated sequences is kept as a wavelet matrix
(one packed bit vector per bit of the alphabet, with a running count for each 64 bits);
suffixes are ordered by their first ``depth`` symbols, which is all that patterns and
matching statistics of that depth need. All searches advance many patterns in step.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A packed bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (U64(1) << (at & 63).astype(np.uint64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows: list[Bits] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.rows.append(Bits(bit.astype(np.uint8)))
            one = bit.astype(bool)
            self.zeros.append(int(len(current) - one.sum()))
            current = np.concatenate((current[~one], current[one]))
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, row in enumerate(self.rows):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = row.ones(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._descend(symbols, at) - self.base[symbols]


class FMIndex:
    """An index of one concatenated text of symbols >= 1, with 0 between its sequences."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        self.depth = depth
        self.size = n = len(text)
        order, group = self._ordered(text, depth)
        # How much neighbouring suffixes share, up to ``depth`` symbols.
        shared = np.zeros(n + 1, np.uint8)
        a, b = order[:-1], order[1:]
        open_ = np.arange(n - 1)
        for d in range(depth):
            inside = (a[open_] + d < n) & (b[open_] + d < n)
            open_ = open_[inside]
            open_ = open_[text[a[open_] + d] == text[b[open_] + d]]
            if not len(open_):
                break
            shared[open_ + 1] = d + 1
        self.shared = shared
        self.matrix = WaveletMatrix(text[order - 1], sigma)
        self.starts = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.starts[1:])
        self._heads: dict[int, np.ndarray] = {}
        heads = self.heads(depth)
        self.first = np.minimum.reduceat(order, heads[:-1]) if n else np.zeros(0, np.int64)

    @staticmethod
    def _ordered(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes by their first ``depth`` symbols, by doubling; ties in any order."""
        n = len(text)
        rank = text.astype(np.int64)
        known = 1
        order = np.argsort(rank, kind="stable")
        while known < depth:
            step = min(known, depth - known)
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * (int(second.max(initial=0)) + 1) + second
            order = np.argsort(key)
            run = key[order]
            fresh = np.ones(n, np.int64)
            fresh[1:] = run[1:] != run[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            known += step
        return order, rank

    def heads(self, d: int) -> np.ndarray:
        """First rows of the groups of suffixes that share ``d`` symbols, and the end."""
        if d not in self._heads:
            self._heads[d] = np.append(np.flatnonzero(self.shared[: self.size] < d) if d else np.zeros(1, np.int64), self.size)
        return self._heads[d]

    def matches(self, queries: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics up to ``depth`` at every position of the queried ranges.

        Returns for each position of ``queries`` how many symbols from there on occur in the
        text, and where that match lies earliest in it if it is ``depth`` long (else -1).
        Symbols that the text lacks are -1. Ranges must not overlap.
        """
        lengths = np.zeros(len(queries), np.int64)
        earliest = np.full(len(queries), -1, np.int64)
        by_size = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[by_size], ends[by_size]
        sizes = ends - starts
        lo, hi, held = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64), np.zeros(len(starts), np.int64)
        heads = self.heads(self.depth)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -back, side="right"))
            at = ends[:live] - back
            symbol = queries[at]
            todo = np.arange(live)
            lost = symbol < 0
            if lost.any():
                gone = np.flatnonzero(lost)
                lo[gone], hi[gone], held[gone] = 0, self.size, 0
                todo = np.flatnonzero(~lost)
            while len(todo):
                c = symbol[todo]
                ranks = self.matrix.rank(np.concatenate((c, c)), np.concatenate((lo[todo], hi[todo])))
                a, b = self.starts[c] + ranks[: len(todo)], self.starts[c] + ranks[len(todo) :]
                ok = b > a
                good = todo[ok]
                lo[good], hi[good] = a[ok], b[ok]
                held[good] += 1
                todo = todo[~ok]
                todo = todo[held[todo] > 0]
                # Drop symbols on the right until the match can grow to the left again.
                for d in np.unique(up := np.maximum(self.shared[lo[todo]], self.shared[hi[todo]])) if len(todo) else ():
                    part = todo[up == d]
                    edge = self.heads(int(d))
                    g = np.searchsorted(edge, lo[part], side="right") - 1
                    lo[part], hi[part], held[part] = edge[g], edge[g + 1], d
            over = np.flatnonzero(held[:live] > self.depth)
            held[over] = self.depth
            full = np.flatnonzero(held[:live] == self.depth)
            if len(full):
                g = np.searchsorted(heads, lo[full], side="right") - 1
                lo[full], hi[full] = heads[g], heads[g + 1]
                earliest[at[full]] = self.first[g]
            lengths[at] = held[:live]
        return lengths, earliest
