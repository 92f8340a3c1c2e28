"""An FM-index over integer symbols: wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``text`` in order, by prefix doubling.

    Only suffixes that still tie are sorted again, so a shard without long repeats
    settles after a few rounds.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate(([True], text[order][1:] != text[order][:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 1
    tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True])))) if n else np.zeros(0, np.int64)
    while len(tied):
        at = order[tied]
        after = at + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((key, group))
        at, group, key = at[by], group[by], key[by]
        order[tied] = at
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        rank[at] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.concatenate((new[1:], [True]))
        tied = tied[~alone]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit per level and symbol with running counts of ones."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(now) - self.ones[-1][-1]))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``upto``, elementwise."""
        low, high = np.zeros_like(upto), upto.copy()
        for i in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            a, b = self.ones[i][low], self.ones[i][high]
            low = np.where(bit, self.zeros[i] + a, low - a)
            high = np.where(bit, self.zeros[i] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at ``at``."""
        out, at = np.zeros_like(at), at.copy()
        for i in range(self.levels):
            a = self.ones[i][at]
            bit = (self.ones[i][at + 1] - a).astype(bool)
            out = (out << 1) | bit
            at = np.where(bit, self.zeros[i] + a, at - a)
        return out


class FMIndex:
    """``text`` holds symbols from 1 up; the index adds a closing 0."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        text = np.concatenate((text.astype(np.int64), [0]))
        order = suffix_array(text)
        self.size = len(text)
        self.top = int(text.max())
        self.bwt = WaveletMatrix(text[order - 1], max(1, self.top.bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.top + 1))))
        marked = order % sample == 0
        self.marked = marked
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.positions = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns (rows padded at the end), by backward search; all step together."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            at = lengths[live] - back
            going = live[at >= 0]
            symbol = patterns[going, lengths[going] - back].astype(np.int64)
            known = symbol <= self.top
            high[going[~known]] = low[going[~known]] = 0
            going, symbol = going[known], symbol[known]
            start = self.before[symbol]
            low[going] = start + self.bwt.rank(symbol, low[going])
            high[going] = start + self.bwt.rank(symbol, high[going])
            live = live[(high > low)[live]]
            if not len(live):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the text to a sampled suffix."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            done = self.marked[r]
            out[live[done]] = self.positions[self.marks[r[done]]] + steps[live[done]]
            live, r = live[~done], r[~done]
            symbol = self.bwt.access(r)
            rows[live] = self.before[symbol] + self.bwt.rank(symbol, r)
            steps[live] += 1
        return out
