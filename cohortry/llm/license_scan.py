"""License scans: matching statistics against a generalised suffix automaton of licence texts, chained into template spans."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .decontaminate import words

# The phrases that alone name a licence, and openings of public licence notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
]

#: Words that a match needs to enter a chain (or the whole template, if it is shorter).
LONG = 3
#: Share of a template's words that a chain must cover to give its label.
COVERED = 0.7
#: Words of other text that a chain may step over.
GAP = 24


@dataclass
class Automaton:
    """A generalised suffix automaton over several word sequences.

    ``places[v]``: the (sequence, last word) places where the strings of state v end.  ``ends[v]``: (length,
    phrase) of the phrases that are suffixes of its strings.
    """

    codes: dict[bytes, int]
    next: list[dict[int, int]]
    link: list[int]
    size: list[int]
    places: list[list[tuple[int, int]]]
    ends: list[list[tuple[int, int]]]


def build(sequences: list[list[bytes]], phrases: list[list[bytes]]) -> Automaton:
    codes: dict[bytes, int] = {}
    nxt: list[dict[int, int]] = [{}]
    link, size, places = [-1], [0], [set()]

    def state(n: int, edges: dict[int, int], to: int) -> int:
        nxt.append(edges)
        size.append(n)
        link.append(to)
        places.append(set())
        return len(nxt) - 1

    def split(p: int, c: int, q: int) -> int:
        """A copy of q for the strings that p reaches by c, shorter than q's own."""
        copy = state(size[p] + 1, dict(nxt[q]), link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    for number, sequence in enumerate(sequences):
        last = 0
        for at, word in enumerate(sequence):
            c = codes.setdefault(word, len(codes))
            q = nxt[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else split(last, c, q)
            else:
                new = state(size[last] + 1, {}, 0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if size[q] == size[p] + 1 else split(p, c, q)
                last = new
            places[last].add((number, at))
    order = sorted(range(1, len(nxt)), key=lambda v: -size[v])
    for v in order:
        places[link[v]] |= places[v]
    ends: list[list[tuple[int, int]]] = [[] for _ in nxt]
    for k, phrase in enumerate(phrases):
        v = 0
        for word in phrase:
            v = nxt[v][codes[word]]
        ends[v].append((len(phrase), k))
    for v in reversed(order):
        ends[v] = ends[v] + ends[link[v]]
    return Automaton(codes, nxt, link, size, [sorted(p) for p in places], ends)


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None):
        phrases = PHRASES if phrases is None else phrases
        notices = NOTICES if notices is None else notices
        self.phrase_labels = list(phrases.values())
        as_words = [words(p) for p in phrases]
        self.labels = self.phrase_labels + [label for label, _ in notices]
        self.templates = as_words + [words(text) for _, text in notices]
        self.automaton = build(self.templates, as_words)

    def matches(self, found: list[bytes]):
        """Places of phrases as (first word, phrase), and right-maximal long matches as (first word, stop, state)."""
        a = self.automaton
        nxt, link, size, ends = a.next, a.link, a.size, a.ends
        base: list[tuple[int, int]] = []
        long: list[tuple[int, int, int]] = []
        v = n = 0
        for i, c in enumerate(map(a.codes.get, found)):
            if c is None:
                if n >= LONG or (n and ends[v]):
                    long.append((i - n, i, v))
                v = n = 0
                continue
            to = nxt[v].get(c)
            if to is None:
                if n >= LONG or (n and ends[v]):
                    long.append((i - n, i, v))
                while to is None and v:
                    v = link[v]
                    n = size[v]
                    to = nxt[v].get(c)
                if to is None:
                    continue
            v = to
            n += 1
            for length, k in ends[v]:
                if length <= n:
                    base.append((i - length + 1, k))
        if n >= LONG or (n and ends[v]):
            long.append((len(found) - n, len(found), v))
        return base, long

    def chains(self, long: list[tuple[int, int, int]]) -> dict[int, list[tuple[float, int, int]]]:
        """For each template met: its chains as (share of the template's words covered, first word, stop).

        A chain's matches follow one another in text and template; what overlaps counts once, and
        at most GAP words of other text lie between two of them.  Each chain is the best that ends
        where it does; of chains that overlap in the text the one that covers most stays (then the earliest).
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, j, v in long:
            for t, end in self.automaton.places[v]:
                by.setdefault(t, []).append((i, j, end + 1))
        out = {}
        for t, met in by.items():
            done: list[tuple[int, int, int, int, int]] = []  # start, stop, template stop, words covered, chain's start
            low = 0
            for i, j, stop in met:
                covered, start = j - i, i
                while low < len(done) and done[low][1] + GAP + len(self.templates[t]) < i:
                    low += 1
                for _, b, s, c, first in done[low:]:
                    if b < j and s < stop and i - b <= GAP:
                        more = c + min(j - max(i, b), stop - max(stop - (j - i), s))
                        if more > covered:
                            covered, start = more, first
                done.append((i, j, stop, covered, start))
            starts: list[int] = []  # of the chains taken, which don't overlap
            taken: dict[int, tuple[float, int, int]] = {}
            for covered, first, stop in sorted(((c, f, j) for _, j, _, c, f in done), key=lambda x: (-x[0], x[1], x[2])):
                at = bisect_left(starts, first)
                if (at < len(starts) and starts[at] < stop) or (at and taken[starts[at - 1]][2] > first):
                    continue
                insort(starts, first)
                taken[first] = (covered / len(self.templates[t]), first, stop)
            out[t] = [taken[f] for f in starts]
        return out

    def scan(self, text: str | None, covered: float = COVERED):
        """``(n_words, phrase places, {label}, {all labels}, score, spans)``."""
        found = words(text)
        base, long = self.matches(found)
        chains = self.chains(long)
        of_phrases = {self.phrase_labels[k] for _, k in base}
        spans = sorted({(i, j, self.labels[t]) for t, found_at in chains.items() for share, i, j in found_at if share >= (1.0 if t < len(self.phrase_labels) else covered)})
        return len(found), base, of_phrases, of_phrases | {s[2] for s in spans}, max((c[0] for found_at in chains.values() for c in found_at), default=0.0), spans


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    notices: list[tuple[str, str]] | None = None,
    covered: float = COVERED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` for every row; no shuffle.

    ``n_base`` counts all places where a phrase's words stand consecutively; first_word and last_word are the smallest
    and largest first word of those (null without any).  ``labels`` are those of the phrases and of all
    templates of which a chain of long matches covers ``covered`` or more; ``score`` is the best template's share covered,
    phrases (which must stand whole to count as a label) included; ``spans`` are the chains' (first word, stop, label).  Null and empty texts have no words and
    score 0; repeated rows and rows without an id are scanned like any other; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, notices))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        for b in batches:
            got = [scan(t.as_py(), covered) for t in b.column(1)]
            firsts = [[i for i, _ in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([len(f) for f in firsts], pa.int64()),
                    pa.array([min(f, default=None) for f in firsts], pa.int64()),
                    pa.array([max(f, default=None) for f in firsts], pa.int64()),
                    pa.array([",".join(sorted(g[2])) for g in got], pa.string()),
                    pa.array([",".join(sorted(g[3])) for g in got], pa.string()),
                    pa.array([min(1.0, g[4]) for g in got], pa.float64()),
                    pa.array([[{"first": i, "stop": j, "label": x} for i, j, x in g[5]] for g in got], kind),
                ],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    of = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, F.col(text_col).alias("text")).mapInArrow(
        run,
        f"`{id_col}` {of}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<first:long,stop:long,label:string>>",
    )
