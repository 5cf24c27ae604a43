"""Operator 10: licence scans by a generalised suffix automaton.

The automaton holds the words of all templates. Each text streams through it and gets matching statistics: at every
word the length of the longest stretch ending there that occurs in a template. Right-maximal long matches are chained,
template by template, into spans; a span that covers enough of its template is a label. Base phrases are strings of the
same automaton: a phrase ends wherever its state lies on the suffix-link path of the state reached.

Only stretches in which all pairs of neighbours are pairs of some template are streamed: a longer match is
impossible elsewhere, so this leaves nothing out.

Scale: one scan, no shuffle; the automaton is as large as the templates (fixed values below) and goes along with the code.

Defined results: null or empty texts have no words, no labels and score 0; repeated rows are scanned one by one; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, id_text, map_rows, text_bytes
from .notices import FULL_TEXTS
from .words import Pairs, flat_ids, runs, words

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public licence notices and the labels they give; whole licence texts follow them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *FULL_TEXTS,
)

#: Words of a match that counts for a chain, words between two of them, and the share of a template a span must cover.
LEAST, GAP, COVER = 3, 12, 0.75


class Automaton:
    """Generalised suffix automaton over sequences of word ids."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: For each state, where its strings end: (template, end) of every occurrence, filled by close().
        self.ends: list[set[tuple[int, int]]] = [set()]

    def _state(self, size: int, of: int | None = None) -> int:
        self.next.append(dict(self.next[of]) if of is not None else {})
        self.link.append(self.link[of] if of is not None else 0)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.size[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        now, p = self._state(self.size[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[now] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return now

    def add(self, ids: list[int]) -> int:
        """Add a sequence; the state that its whole length reaches."""
        last = 0
        for c in ids:
            last = self._extend(last, c)
        return last

    def mark(self, template: int, ids: list[int]) -> None:
        """Record where a sequence's prefixes end; call when all sequences are added."""
        state = 0
        for end, c in enumerate(ids):
            state = self.next[state][c]
            at = state
            while at > 0:
                self.ends[at].add((template, end))
                at = self.link[at]

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The state and match length after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        to = self.next[state].get(c)
        return (to, size + 1) if to is not None else (0, 0)


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE, least: int = LEAST, gap: int = GAP, cover: float = COVER):
        self.least, self.gap, self.cover = least, gap, cover
        self.vocab: dict[bytes, int] = {}
        number = lambda text: [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text.encode())]
        self.labels, self.ids = [t[0] for t in templates], [number(t[1]) for t in templates]
        self.base_labels, self.base_ids = [b[1] for b in base], [number(b[0]) for b in base]
        self.automaton = Automaton()
        for ids in self.ids + self.base_ids:
            self.automaton.add(ids)
        for k, ids in enumerate(self.ids):
            self.automaton.mark(k, ids)
        self.base_at: dict[int, list[int]] = {}
        for k, ids in enumerate(self.base_ids):
            state = 0
            for c in ids:
                state = self.automaton.next[state][c]
            self.base_at.setdefault(state, []).append(k)
        #: Of each state the phrases that end its strings.
        self.phrases: list[list[int]] = [[] for _ in self.automaton.size]
        for state in sorted(range(1, len(self.phrases)), key=self.automaton.size.__getitem__):
            self.phrases[state] = self.base_at.get(state, []) + self.phrases[self.automaton.link[state]]
        self.pairs = Pairs(np.concatenate([Pairs.key(np.array(x[:-1]), np.array(x[1:])) for x in self.ids + self.base_ids]))
        self.last_words = np.zeros(len(self.vocab) + 1, bool)
        self.last_words[[x[-1] for x in self.base_ids]] = True

    def stretch(self, ids: list[int], start: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base places (phrase, first word) and right-maximal matches (last word, length, state) of one stretch."""
        state = size = 0
        places, matches = [], []
        for k, c in enumerate(ids):
            was, had = state, size
            state, size = self.automaton.step(state, size, c)
            if had >= self.least and size != had + 1:
                matches.append((start + k - 1, had, was))
            for p in self.phrases[state]:
                if size >= (n := len(self.base_ids[p])):
                    places.append((p, start + k - n + 1))
        if size >= self.least:
            matches.append((start + len(ids) - 1, size, state))
        return places, matches

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Spans (template, first word, last word, share covered) of chained matches."""
        open_: dict[int, list] = {}
        done = []

        def close(t: int) -> None:
            first, last, _, covered = open_.pop(t)
            share = min(1.0, covered / len(self.ids[t]))
            if share >= self.cover:
                done.append((t, first, last, share))

        for last, size, state in matches:
            by: dict[int, list[int]] = {}
            for t, end in self.automaton.ends[state]:
                by.setdefault(t, []).append(end)
            for t, ends in by.items():
                first = last - size + 1
                if t in open_:
                    was = open_[t]
                    later = [e for e in ends if e > was[2]]
                    if later and first - was[1] <= self.gap:
                        # Overlapping matches count their words once, in the text and in the template.
                        end = min(later)
                        was[3] += min(size, last - was[1], end - was[2])
                        was[1], was[2] = last, end
                        continue
                    close(t)
                open_[t] = [first, last, min(ends), size]
        for t in list(open_):
            close(t)
        return sorted(done)


@cache
def scanner() -> Scanner:
    return Scanner()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, base places and labels, chained template spans, all labels and a score (the best cover)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scanner()
        texts = text_bytes(batch)
        ids, counts = flat_ids(texts, s.vocab.get)
        ends = np.cumsum(counts)
        links = s.pairs.links(ids, ends)
        start, size = runs(links)
        closing = np.concatenate(([0], np.cumsum(s.last_words[ids])))
        live = (size >= s.least) | (closing[start + size] > closing[start])
        places: dict[int, list] = {}
        matches: dict[int, list] = {}
        for a, n in zip(start[live].tolist(), size[live].tolist(), strict=True):
            k = int(np.searchsorted(ends, a, "right"))
            p, m = s.stretch(ids[a : a + n].tolist(), a - int(ends[k] - counts[k]))
            if p:
                places.setdefault(k, []).extend(p)
            if m:
                matches.setdefault(k, []).extend(m)
        cols: list[list] = [[] for _ in range(7)]
        for k in range(len(texts)):
            p = places.get(k, ())
            spans = s.chain(matches[k]) if k in matches else []
            base = sorted({s.base_labels[x] for x, _ in p})
            every = sorted({*base, *(s.labels[t] for t, *_ in spans)})
            row = (len(p), min((w for _, w in p), default=None), max((w for _, w in p), default=None), base, every, [{"label": s.labels[t], "first": a, "last": b, "cover": c} for t, a, b, c in spans], max([0.5 if p else 0.0, *(c for *_, c in spans)]))
            for to, v in zip(cols, row, strict=True):
                to.append(v)
        names = pa.list_(pa.string())
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), names, names, span, pa.float64())
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(map_rows(run), SCHEMA)
