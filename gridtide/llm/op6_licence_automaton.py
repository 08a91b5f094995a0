"""Licence scans by a generalised suffix automaton of licence notices.

The automaton is built over the words of all notices. Streaming a text's words through it gives matching statistics: at each
word the length of the longest run, ending there, that some notice contains. Maximal runs of at least `least` words are
chained per notice, in order in text and notice without overlap, and a notice whose chained runs cover at least `share` of
its words adds its label. The score is the largest covered share, and 1 for a text that names a base phrase.

Only words that two notices' neighbours could form reach the automaton: elsewhere matches are shorter than two words.

Base phrases give n_base, first_word, last_word and base_labels, as said for the query.

Defined results: null counts as empty; a text without words has n_words 0, null places, empty labels and score 0; repeated rows
are scanned alike; other columns are kept, `text` is not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridtide.llm import kernel, tables

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening or central sentences of public licence notices.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def split(text: str) -> list[str]:
    data = kernel.words_of(pa.array([text]), kernel.WORD_BYTE)
    return [bytes(data.data[a:b]).decode() for a, b in zip(data.starts, data.ends, strict=True)]


class Automaton:
    """Suffix automaton of several sequences of word numbers; each state knows where in which sequence its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for i, words in enumerate(sequences):
            last, states = 0, []
            for w in words:
                last = self._extend(last, w)
                states.append(last)
            for at, state in enumerate(states):
                self.ends[state].append((i, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):  # longer runs end where their suffixes do
            self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state reached by w from p, of exactly one word more than p."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        self.link[state] = self._split(p, w) if p >= 0 else 0
        return state

    def runs(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each maximal run: the next word does not prolong it."""
        state, length, held = 0, 0, None
        for at, w in enumerate(words):
            grown = w in self.next[state]
            if not grown and held is not None:
                yield held
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
                held = (at, length, state)
            else:
                held = None
        if held is not None:
            yield held


def chained(matches: list[tuple[int, int, int]]) -> int:
    """Most notice words covered by matches (text start, notice start, length) in order in both without overlap."""
    matches = sorted(matches)
    best: list[int] = []
    for i, (a, b, n) in enumerate(matches):
        before = 0
        for j in range(i):
            x, y, _ = matches[j]
            gap = min(a - x, b - y)  # words of match j that remain before this one starts
            if gap > 0:
                before = max(before, best[j] - max(0, matches[j][2] - gap))
        best.append(before + n)
    return max(best, default=0)


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES, least: int = 4, share: float = 0.6):
        self.least, self.share, self.phrases = least, share, phrases
        self.labels = [label for label, _ in notices]
        sequences = [split(text) for _, text in notices]
        named = [split(text) for text, _ in phrases]
        vocabulary = sorted({w for s in [*sequences, *named] for w in s})
        hashed = np.array([kernel.word_hash(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashed)
        self.hashes, self.numbers = hashed[order], order.astype(np.int32)
        number = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [[number[w] for w in s] for s in sequences]
        self.named = [[number[w] for w in s] for s in named]
        self.pair = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)  # the last number: no word of a notice
        for s in self.sequences:
            self.pair[s[:-1], s[1:]] = True
        self.automaton = Automaton(self.sequences)

    def scan(self, words: kernel.Words) -> dict[str, list]:
        rows = len(words.counts)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        none = len(self.hashes)
        ids = np.where(self.hashes[at] == h, self.numbers[at], none).astype(np.int32)
        doc = words.doc
        n_base = np.zeros(rows, np.int64)
        first = np.full(rows, np.iinfo(np.int64).max)
        last = np.full(rows, -1, np.int64)
        base: list[set[str]] = [set() for _ in range(rows)]
        for s, (_, label) in zip(self.named, self.phrases, strict=True):
            n = len(ids) - len(s) + 1
            if n <= 0:
                continue
            hit = np.ones(n, bool)
            for j, w in enumerate(s):
                hit &= ids[j : j + n] == w
            hit = np.flatnonzero(hit)
            hit = hit[doc[hit] == doc[hit + len(s) - 1]]
            place = hit - words.first[doc[hit]]
            np.add.at(n_base, doc[hit], 1)
            np.minimum.at(first, doc[hit], place)
            np.maximum.at(last, doc[hit], place)
            for row in np.unique(doc[hit]).tolist():
                base[row].add(label)
        labels = [set(x) for x in base]
        score = np.array([1.0 if x else 0.0 for x in base])
        for row, covered in self._covered(ids, doc, words.first):
            for notice, n in covered.items():
                part = n / len(self.sequences[notice])
                score[row] = max(score[row], part)
                if part >= self.share:
                    labels[row].add(self.labels[notice])
        found = n_base > 0
        return {
            "n_words": words.counts.astype(np.int64),
            "n_base": n_base,
            "first_word": pa.array(np.where(found, first, 0), pa.int64(), mask=~found),
            "last_word": pa.array(np.where(found, last, 0), pa.int64(), mask=~found),
            "base_labels": pa.array([",".join(sorted(x)) for x in base], pa.string()),
            "labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()),
            "score": np.minimum(score, 1.0),
        }

    def _covered(self, ids: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, dict[int, int]]]:
        """(row, {notice: covered words}) of rows with long matches."""
        if len(ids) < 2:
            return
        joined = self.pair[ids[:-1], ids[1:]] & (doc[:-1] == doc[1:])
        on = np.concatenate(([False], joined, [False]))
        edge = np.flatnonzero(on[1:] != on[:-1])
        begin, end = edge[::2], edge[1::2] + 1  # words begin..end-1 are neighbours in notices
        long = end - begin >= self.least
        matches: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            row = int(doc[a])
            for stop, length, state in self.automaton.runs(ids[a:b].tolist()):
                if length >= self.least:
                    for notice, place in self.automaton.ends[state]:
                        matches.setdefault(row, {}).setdefault(notice, []).append((a + stop - length + 1, place - length + 1, length))
        for row, by_notice in matches.items():
            yield row, {notice: chained(found) for notice, found in by_notice.items()}


class _Scan:
    def __init__(self, scanner: Scanner):
        self.scanner = scanner

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.texts(batches):
            found = self.scanner.scan(kernel.words_of(batch.column("text"), kernel.WORD_BYTE))
            kept = {x: batch.column(x) for x in batch.schema.names if x != "text"}
            yield pa.record_batch(kept | {k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in found.items()})


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """All columns of docs but text, with the columns of the scan (in place of columns of these names). A scanner is as
    large as its notices (some 100 kB)."""
    docs = docs.drop(*[x.split()[0] for x in FOUND.split(", ")])
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(_Scan(scanner or Scanner()), own + FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tables.documents(spark, sf_dir).select("doc_id", "text"))
