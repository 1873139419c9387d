"""Word-level suffix arrays in whole suffix order, and the binary search of many suffixes in one.

Words are numbers from 1; a 0 ends a run of words. A suffix is what stands from a position to the end of its run; where one ends
it is smaller than any that goes on. Several words are packed into one 64-bit key, so that a comparison looks at several at once.
"""

from __future__ import annotations

import numpy as np


class Keys:
    """The packed words from every position of `words`, zeros behind the end of a run."""

    def __init__(self, words: np.ndarray, highest: int):
        self.bits = max(1, int(highest).bit_length())
        self.width = max(1, 62 // self.bits)
        n = len(words)
        padded = np.zeros(n + self.width + 1, np.int64)
        padded[:n] = words
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.width):
            here = padded[k : k + n]
            alive = alive & (here > 0)
            key = (key << self.bits) | np.where(alive, here, 0)
        #: One more position, which stands for whatever lies behind the end.
        self.key = np.append(key, 0)

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.key[np.minimum(positions, len(self.key) - 1)]

    def whole(self, keys: np.ndarray) -> np.ndarray:
        """Whether a key's last word is there, so that its suffix may go on."""
        return keys & ((1 << self.bits) - 1) > 0

    def mask(self, words: np.ndarray) -> np.ndarray:
        """The bits of a key behind its first `words` words."""
        rest = self.bits * (self.width - np.clip(words, 0, self.width))
        return (np.int64(1) << rest.astype(np.int64)) - 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that two keys have in common at their beginning; a 0 is no word."""
        n = np.zeros(len(a), np.int64)
        same = np.ones(len(a), bool)
        for k in range(self.width - 1, -1, -1):
            x, y = a >> (k * self.bits) & ((1 << self.bits) - 1), b >> (k * self.bits) & ((1 << self.bits) - 1)
            same &= (x == y) & (x > 0)
            n += same
        return n


def runs(words: np.ndarray) -> np.ndarray:
    """Words in a row from every position."""
    n = len(words)
    stops = np.append(np.flatnonzero(words == 0), n)
    return stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)


def suffix_order(keys: Keys, run: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """`positions` in the order of their whole suffixes, by prefix doubling; equal suffixes by position.

    With a position all later ones of its run must be among `positions`, which ascend.
    """
    if not len(positions):
        return positions
    n = len(keys.key)
    rank = np.zeros(n + 1, np.int64)  # 0 stands for an ended suffix

    def ranked(order: np.ndarray, values: np.ndarray) -> int:
        new = np.append(True, values[1:] != values[:-1]).cumsum()
        rank[positions[order]] = new
        return int(new[-1])

    first = keys.key[positions]
    order = np.argsort(first, kind="stable")
    different, seen = ranked(order, first[order]), keys.width
    longest = int(run[positions].max())
    while different < len(positions) and seen < longest:
        own = rank[positions]
        behind = np.where(run[positions] > seen, rank[np.minimum(positions + seen, n)], 0)
        value = own * (len(positions) + 1) + behind
        order = np.argsort(value, kind="stable")
        different, seen = ranked(order, value[order]), 2 * seen
    return positions[order]


def _bound(array: Keys, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray, past: bool) -> np.ndarray:
    """The first place in [low, high) whose key at `depth` isn't below `wanted` (past: is above)."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        found = array.at(order[mid] + depth)
        right = found <= wanted[open_] if past else found < wanted[open_]
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


class SuffixArray:
    """The suffixes of a shard's words that have `least` words at least, in whole suffix order."""

    def __init__(self, words: np.ndarray, least: int, highest: int):
        run = runs(words)
        self.keys = Keys(words, highest)
        # All positions of the runs that are long enough give the order; the suffixes that are too short are dropped from it.
        start = np.append(True, words[:-1] == 0) if len(words) else np.zeros(0, bool)
        begin = np.flatnonzero(start)
        long = np.repeat(run[begin] >= least, np.diff(np.append(begin, len(words)))) & (words > 0)
        order = suffix_order(self.keys, run, np.flatnonzero(long))
        self.order = order[run[order] >= least]
        self.first = self.keys.key[self.order]

    def ranges(self, tests: Keys, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that begin with the `length` words of each test position."""
        width = tests.width
        wanted = tests.at(start)
        mask = tests.mask(length)
        low = np.searchsorted(self.first, wanted & ~mask, "left")
        high = np.searchsorted(self.first, wanted | mask, "right")
        depth = width
        while (open_ := np.flatnonzero((length > depth) & (low < high))).size:
            wanted, mask = tests.at(start[open_] + depth), tests.mask(length[open_] - depth)
            a, b = low[open_], high[open_]
            low[open_] = _bound(self.keys, self.order, a, b, depth, wanted & ~mask, False)
            high[open_] = _bound(self.keys, self.order, low[open_], b, depth, wanted | mask, True)
            depth += width
        return low, high

    def places(self, tests: Keys, start: np.ndarray) -> np.ndarray:
        """How many suffixes are smaller than each whole test suffix."""
        wanted = tests.at(start)
        low = np.searchsorted(self.first, wanted, "left")
        high = np.searchsorted(self.first, wanted, "right")
        depth, open_ = tests.width, np.flatnonzero((low < high) & tests.whole(wanted))
        while open_.size:
            wanted = tests.at(start[open_] + depth)
            a, b = low[open_], high[open_]
            low[open_] = _bound(self.keys, self.order, a, b, depth, wanted, False)
            high[open_] = _bound(self.keys, self.order, low[open_], b, depth, wanted, True)
            open_ = open_[(low[open_] < high[open_]) & tests.whole(wanted)]
            depth += tests.width
        return low


def common_words(a: Keys, x: np.ndarray, b: Keys, y: np.ndarray) -> np.ndarray:
    """Words that the suffix of a at each x and that of b at each y have in common."""
    out = np.zeros(len(x), np.int64)
    open_, depth = np.arange(len(x)), 0
    while open_.size:
        p, q = a.at(x[open_] + depth), b.at(y[open_] + depth)
        same = p == q
        ended = np.flatnonzero(~same | ~a.whole(p))
        out[open_[ended]] = depth + a.common(p[ended], q[ended])
        open_ = np.delete(open_, ended)
        depth += a.width
    return out
