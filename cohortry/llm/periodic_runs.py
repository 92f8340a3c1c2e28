"""Periodic runs of words, found on a Re-Pair grammar of each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy
from .tokens import by_bytes

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words of which a stretch in a run recurs a period later, however short or long the period is (see ``stretches``), ...
STRETCH = 9
#: ... and of which a stretch beside a boundary recurs a period later within the longer side of a run (see ``candidates``).
BESIDE = 4
#: Candidate periods compared at a time.
AT_ONCE = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repair(symbols: list[int], fresh: int) -> tuple[list[tuple[int, int, int, list[int]]], list[int]]:
    """The Re-Pair grammar of ``symbols``: rules, and where the symbols of the last sequence start.

    The pair of neighbours that stands at the most places (without overlaps) becomes a new symbol, numbered from
    ``fresh`` on, until no pair stands twice.  A rule is ``(size of its left part, its size, first place, places)``
    in words, its places being all its nodes in the derivation.
    """
    n = len(symbols)
    now = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(now, now[1:])):
        places.setdefault(pair, []).append(i)
    # Counts are upper bounds: places that later replacements took are found when a pair comes up.
    queue = [(-len(at), at[0], pair) for pair, at in places.items() if len(at) > 1]
    heapify(queue)
    size: dict[int, int] = {}
    rules = []
    while queue:
        told, _, pair = heappop(queue)
        a, b = pair
        live, free = [], 0
        for i in places[pair]:
            if i >= free and now[i] == a and (j := after[i]) < n and now[j] == b:
                live.append(i)
                free = j + 1
        if len(live) < 2:
            del places[pair]
            continue
        if len(live) < -told:
            places[pair] = live
            heappush(queue, (-len(live), live[0], pair))
            continue
        del places[pair]
        new: dict[tuple[int, int], list[int]] = {}
        for i in live:
            j = after[i]
            k = after[j]
            now[i], now[j] = fresh, -1
            after[i] = k
            if k < n:
                before[k] = i
                new.setdefault((fresh, now[k]), []).append(i)
            if (h := before[i]) >= 0:
                new.setdefault((now[h], fresh), []).append(h)
        left = size.get(a, 1)
        size[fresh] = left + size.get(b, 1)
        rules.append((left, size[fresh], live[0], live))
        fresh += 1
        for key, at in new.items():
            if len(at) > 1:
                places[key] = at
                heappush(queue, (-len(at), at[0], key))
    ends, i = [], 0
    while i < n:
        ends.append(i)
        i = after[i]
    return rules, ends


def stretches(codes: np.ndarray) -> np.ndarray:
    """Which words of ``codes`` (of one or more texts, no code in two texts) can be in a run.

    Every STRETCH words inside a run stand in it again a period earlier or later: a run of period q has at least 3q words
    and 24, so 2q or more places where so many words fit (3q - 8 for q of 8 or more, 16 for less).  Hence a run lies in a row of
    places with recurring stretches, 16 at least.  Hashes tell which recur; one that clashes only keeps a word too many.
    """
    n = len(codes) - STRETCH + 1
    kept = np.zeros(len(codes), bool)
    if n < LEAST_WORDS - STRETCH + 1:
        return kept
    mixed = _mixed(codes)
    h = np.zeros(n, np.uint64)
    for k in range(STRETCH):
        h = h * _ODD + mixed[k : k + n]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    often = np.zeros(n + 2, bool)
    often[order[1:][same] + 1] = True
    often[order[:-1][same] + 1] = True
    edges = np.flatnonzero(often[1:] != often[:-1])
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if j - i >= LEAST_WORDS - STRETCH + 1:
            kept[i : j + STRETCH - 1] = True
    return kept


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * _ODD
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Same:
    """How far equal words go on from two places of ``codes``, for many places at once, by hashes of prefixes.

    Words that are equal always have equal hashes, so nothing equal is missed; what a clash says too much, ``crossing`` takes back.
    """

    def __init__(self, codes: np.ndarray):
        odd = np.full(len(codes) + 1, _ODD)
        odd[0] = 1
        self.power = np.cumprod(odd)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes) * self.power[:-1], out=self.sums[1:])

    def _far(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, sign: int) -> np.ndarray:
        low, high, shift = np.zeros_like(limit), limit.copy(), self.power[j - i]
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live] + 1) >> 1
            x, y = i[live], j[live]
            a, b = (self.sums[x + sign * mid] - self.sums[x]) * shift[live], self.sums[y + sign * mid] - self.sums[y]
            low[live] = np.where(a == b, mid, low[live])
            high[live] = np.where(a == b, high[live], mid - 1)
        return low

    def forward(self, i, j, limit):
        return self._far(i, j, limit, 1)

    def backward(self, i, j, limit):
        return self._far(i, j, limit, -1)


def _named(codes: np.ndarray) -> np.ndarray:
    """A number for every BESIDE words from each place on, equal where the words are; the last places have numbers of their own."""
    n = len(codes)
    for width in (1, 2):
        own = np.arange(n, n + width)
        pair = codes.astype(np.int64) * (2 * n + 2) + np.concatenate((codes[width:], own))[:n]
        codes = np.unique(pair, return_inverse=True)[1]
    return codes


def candidates(names: np.ndarray, order: np.ndarray, keys: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(node, place, period)`` to try for boundaries ``middle`` inside ``[start, stop)``, AT_ONCE or so at a time.

    Of a run over a boundary the longer side has 1.5 periods and 12 words or more, so the BESIDE words next to the boundary on
    that side recur in it a period away; all such places within a third of the node are tried.
    """
    n = len(names)
    most = (stop - start) // LEAST_TIMES
    sides = []
    right = np.flatnonzero(middle + BESIDE <= stop)
    at = middle[right]
    sides.append((right, at, at + 1, np.minimum(at + most[right], stop[right] - BESIDE) + 1))
    left = np.flatnonzero(middle - BESIDE >= start)
    at = middle[left] - BESIDE
    sides.append((left, at, np.maximum(at - most[left], start[left]), at))
    for node, at, low, high in sides:
        first = np.searchsorted(keys, names[at] * n + low)
        many = np.maximum(np.searchsorted(keys, names[at] * n + np.maximum(high, low)) - first, 0)
        total = np.cumsum(many)
        i = 0
        while i < len(node):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE, "right")))
            m = many[i:j]
            back = np.repeat(np.cumsum(m) - m, m)
            place = order[np.repeat(first[i:j], m) + np.arange(m.sum()) - back]
            own = np.repeat(at[i:j], m)
            yield np.repeat(node[i:j], m), np.minimum(place, own), np.abs(place - own)
            i = j


def _compared(codes: np.ndarray, i: int, q: int, start: int, stop: int) -> tuple[int, int]:
    """The stretch of period ``q`` around place ``i`` within ``[start, stop)``, by the words themselves."""
    other = np.flatnonzero(codes[i : stop - q] != codes[i + q : stop])
    earlier = np.flatnonzero(codes[start:i] != codes[start + q : i + q])
    return (start + int(earlier[-1]) + 1 if len(earlier) else start), (i + q + int(other[0]) if len(other) else stop)


def crossing(codes: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(node, start, stop, period)`` of the runs over the boundary of each node ``[start, stop)``, as long as they are within it."""
    n = len(codes)
    names = _named(codes)
    order = np.argsort(names, kind="stable")
    keys = names[order] * n + order
    same = Same(codes)
    out: dict[tuple[int, int, int], int] = {}
    for node, i, q in candidates(names, order, keys, start, middle, stop):
        j = i + q
        end = j + same.forward(i, j, stop[node] - j)
        begin = i - same.backward(i, j, i - start[node])
        long = end - begin >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
        for x, a, s, e, p in zip(*(c[long].tolist() for c in (node, i, begin, end, q))):
            if p >= out.get((x, s, e), n):
                continue
            if not np.array_equal(codes[s : e - p], codes[s + p : e]):
                s, e = _compared(codes, a, p, s, e)
            # Of the periods of one stretch the smallest counts.
            if e - s >= max(LEAST_WORDS, LEAST_TIMES * p) and p < out.get((x, s, e), n):
                out[x, s, e] = p
    return [(*key, p) for key, p in out.items()]


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each text, a list of words, by start and period.

    1. Stretches that can hold a run are kept (``stretches``), parted by symbols of their own.  2. Each text gets a Re-Pair
    grammar; the symbols of its last sequence are joined by a balanced tree.  3. The runs over a rule's boundary are computed once,
    at its first place, within the rule.  4. They are carried to all places of the rule, and intervals of one period that
    overlap by a period or more are one run.  A run is whole in the lowest node that holds all of it, so none is missed.
    """
    sizes = [len(t) for t in texts]
    offset = np.concatenate(([0], np.cumsum(sizes)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hashed = np.array([hash(w) for t in texts for w in t], np.int64) if offset[-1] else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = stretches(_mixed(hashed) + owner.astype(np.uint64) * _ODD)
    if not kept.any():
        return found
    line: list[int] = []  # symbols of all kept stretches; the place of each in its text
    where: list[np.ndarray] = []
    cuts = [0]
    number = 0
    for t in np.unique(owner[kept]).tolist():
        words, own = texts[t], np.flatnonzero(kept[offset[t] : offset[t + 1]])
        parts = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
        known: dict = {}
        for part in parts:
            line += [known.setdefault(words[k], number + len(known)) for k in part.tolist()]
            line.append(-1 - len(line))
            where += [part, np.array([-1])]
        number += len(known)
        cuts.append(len(line))
    symbols = np.array(line)
    symbols[symbols < 0] = number + np.arange(np.count_nonzero(symbols < 0))
    places = np.concatenate(where)
    start, middle, stop, nodes = [], [], [], []
    for low, high in zip(cuts, cuts[1:]):
        rules, ends = repair(symbols[low:high].tolist(), int(symbols.max()) + 1)
        for left, size, first, all_places in rules:
            start.append(low + first)
            middle.append(low + first + left)
            stop.append(low + first + size)
            nodes.append(all_places)
        # A balanced tree over the last sequence: boundary i is the middle of the block of symbols around it.
        last = [*ends, high - low]
        for i in range(1, len(ends)):
            half = i & -i
            start.append(low + last[i - half])
            middle.append(low + last[i])
            stop.append(low + last[min(i + half, len(ends))])
            nodes.append(None)
    start, middle, stop = (np.array(x, np.int64) for x in (start, middle, stop))
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    doc = np.repeat(np.unique(owner[kept]), np.diff(cuts))
    low_of = np.repeat(cuts[:-1], np.diff(cuts))
    for node, s, e, q in crossing(symbols, start, middle, stop):
        t = int(doc[s])
        base = int(start[node]) - int(low_of[s])
        for at in [base] if nodes[node] is None else nodes[node]:
            spans.setdefault((t, q), []).append((s + at - base, e + at - base))
    whole: dict[tuple[int, int, int], int] = {}
    for (t, q), some in spans.items():
        merged: list[list[int]] = []
        for s, e in sorted(some):
            if merged and s <= merged[-1][1] - q:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            whole[t, s, e] = min(q, whole.get((t, s, e), q))
    for (t, s, e), q in whole.items():
        found[t].append((int(places[s]), e - s, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run repeats: all of it after its first period."""
    if not runs:
        return words
    stay = np.ones(len(words), bool)
    for s, size, q in runs:
        stay[s + q : s + size] = False
    return [w for w, yes in zip(words, stay.tolist()) if yes]


def _words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def _told(docs: DataFrame, made, columns: dict[str, pa.DataType], kinds: str, id_col: str, text_col: str) -> DataFrame:
    """One row for every row of ``docs``: its id and what ``made(words, runs)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in by_bytes(b.column(1).to_pylist()):
                words = [_words(t.as_py()) for t in b.column(1).slice(i, j - i)]
                rows = zip(*(made(w, r) for w, r in zip(words, runs_of(words))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(rows, columns.values()))], names=[id_col, *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, {kinds}")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, runs, collapsed)`` for every row: its runs ``(start, length, period)`` and its words without their repeats.

    A run is a stretch of words (between ASCII white space) of smallest period q, of at least 24 words and 3q, that can't be longer with that
    period.  ``collapsed`` keeps a run's first q words, joined by one space.  Null and empty texts have no words and no runs; rows with
    a null or repeated id stand for themselves; other columns are ignored.  No shuffle; a task holds the words of about 1 MB of
    text, or of one longer text.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def made(words, runs):
        return [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept_words(words, runs)).decode()

    return _told(docs, made, {"runs": kind, "collapsed": pa.string()}, "runs array<struct<start:long,length:long,period:long>>, collapsed string", id_col, text_col)


def runs_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` for every row.

    The run told is that of the greatest length by period, then the smallest start, then period; nulls where there is none.
    Rows and texts are taken as in ``periodic_runs``.
    """
    long, text = pa.int64(), pa.string()

    def made(words, runs):
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = b" ".join(kept_words(words, runs))
        return len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    columns = {"n_runs": long, "start": long, "length": long, "period": long, "exponent_milli": long, "runs_sha256": text, "collapsed_sha256": text}
    return _told(docs, made, columns, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", id_col, text_col)


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic end put into every text whose id's CRC-32 (of its decimal digits) is divisible by 10.

    With g that number over 10, words from a = g mod n on repeat the p words from a, p being 1 + (n - a) / (3 + g mod 8).
    Such texts have their words joined by one space; others, and rows with a null id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def ended(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), 11))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, ended(w)).otherwise(F.lit(""))), 1)
    return docs.withColumn(text_col, F.when((F.pmod(h, F.lit(10)) == 0) & F.col(text_col).isNotNull(), changed).otherwise(F.col(text_col)))
