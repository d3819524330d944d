"""License scans with a generalised suffix automaton.

The automaton holds every run of words of all templates.  Words of a file stream through it; after each, the length of the
longest run of template words that ends there is known (the matching statistics).  Where that length stops growing, a match is
maximal.  Matches of ``LEAST`` words or more, or of a whole shorter template, are chained while file and template both move on
by no more than ``GAP`` words; a chain that covers enough of its template is a span with the template's label.

The templates are a fixed list, so the automaton has a fixed size.  Words whose pairs with both neighbours are in no
template cannot be part of a match of two words and are passed over before the walk.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from palisade.llm import base, words as W

LEAST, GAP, COVER = 4, 8, 0.75

# Phrases that count wherever their words stand together, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Openings and notices of public licences, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later "
     "version", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 2 of the license or at your option any later "
     "version", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights "
     "to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under the creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)


class Automaton:
    """Generalised suffix automaton over sequences of numbers, with where each state's runs end in the sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((number, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        ends[0] = set()
        self.ends = [sorted(e) for e in ends]

    def _state(self, length, ends, like=None):
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, at, word, to, ends):
        """The state of the runs through ``at``, taken out of ``to`` where that also holds longer ones."""
        if self.length[at] + 1 == self.length[to]:
            return to
        copy = self._state(self.length[at] + 1, ends, like=to)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last, word, ends):
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word], ends)
        new, at = self._state(self.length[last] + 1, ends), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        self.link[new] = self._split(at, word, self.next[at][word], ends) if at >= 0 else 0
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) after each word: the longest run that ends there and is in some sequence."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append((state, length))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [(t.encode().split(), label) for t, label in (*phrases, *templates)]
        if any(len(words) < 2 for words, _ in texts):
            raise ValueError("phrases and templates need two words or more")
        number: dict[bytes, int] = {}
        self.sequences = [[number.setdefault(w, len(number) + 1) for w in words] for words, _ in texts]
        self.labels, self.n_phrases = [label for _, label in texts], len(phrases)
        self.vocabulary, self.automaton = W.Vocabulary(list(number)), Automaton(self.sequences)
        pairs = {(a, b) for s in self.sequences for a, b in zip(s, s[1:])}
        self.width = len(number) + 1
        self.pairs = np.array(sorted(a * self.width + b for a, b in pairs), np.int64)
        # States at which a phrase ends, also inside longer runs.
        self.phrase_of = [[] for _ in self.automaton.link]
        for k in range(self.n_phrases):
            state = 0
            for word in self.sequences[k]:
                state = self.automaton.next[state][word]
            self.phrase_of[state].append(k)

    def _walk(self, words: list[int], start: int, bases: list, matches: list):
        auto = self.automaton
        found = auto.statistics(words)
        for i, (state, length) in enumerate(found):
            up, limit = state, length
            while up > 0:
                bases += [(start + i + 1 - len(self.sequences[k]), k) for k in self.phrase_of[up] if len(self.sequences[k]) <= limit]
                up = auto.link[up]
                limit = auto.length[up] if up >= 0 else 0
            if i + 1 == len(found) or found[i + 1][1] <= length:
                matches.append((start + i + 1 - length, length, state))

    def scan(self, block) -> dict[int, tuple[list, list]]:
        """Per text with something in it: places of phrases, and spans (label, start, words, share)."""
        numbers = self.vocabulary.numbers(block)
        if len(numbers) < 2:
            return {}
        pair = np.isin(numbers[:-1] * self.width + numbers[1:], self.pairs) & (numbers[:-1] > 0) & (numbers[1:] > 0)
        borders = block.first[1:-1] - 1
        pair[borders[(borders >= 0) & (borders < len(pair))]] = False  # not across texts
        edge = np.flatnonzero(np.diff(np.concatenate([[0], pair.astype(np.int8), [0]])))
        out: dict[int, tuple[list, list]] = {}
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            row = int(np.searchsorted(block.first, lo, "right") - 1)
            bases, matches = out.setdefault(row, ([], []))
            self._walk(numbers[lo:hi + 1].tolist(), lo - int(block.first[row]), bases, matches)
        return {row: (bases, self._chain(matches)) for row, (bases, matches) in out.items()}

    def _chain(self, matches) -> list[tuple[str, int, int, float]]:
        spans, open_ = [], {}  # of a template: file start, file end, template end, words covered

        def close(t):
            start, end, _, covered = open_.pop(t)
            share = covered / len(self.sequences[t])
            if share >= COVER:
                spans.append((self.labels[t], start, end - start, share))

        for start, length, state in matches:
            places: dict[int, list[int]] = {}
            for t, end in self.automaton.ends[state]:
                places.setdefault(t, []).append(end - length + 1)
            for t, at in places.items():
                if length < min(LEAST, len(self.sequences[t])):
                    continue
                now = open_.get(t)
                ahead = [p for p in at if now and 0 <= p - now[2] <= GAP and 0 <= start - now[1] <= GAP]
                if ahead:
                    open_[t] = (now[0], start + length, ahead[0] + length, now[3] + length)
                else:
                    if now:
                        close(t)
                    open_[t] = (start, start + length, at[0] + length, length)
        for t in list(open_):
            close(t)
        return spans


SCHEMA = ("doc_id long, n_words long, bases array<struct<start:long,label:string>>, "
          "spans array<struct<label:string,start:long,n_words:long,share:double>>")


def _scan(shared):
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        scanner = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            bases, spans = [[] for _ in n_words], [[] for _ in n_words]
            for block in W.blocks(batch.column(1), W.NON_WORD, lower=True):
                n_words[block.rows] = np.diff(block.first)
                for row, (own, chained) in scanner.scan(block).items():
                    bases[block.rows[row]] = [{"start": s, "label": scanner.labels[k]} for s, k in sorted(own)]
                    spans[block.rows[row]] = [dict(zip(("label", "start", "n_words", "share"), s)) for s in chained]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(bases, base_type), pa.array(spans, span_type)],
                ["doc_id", "n_words", "bases", "spans"])
    return run


def scanned(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, bases (start, label), spans (label, start, n_words, share) for every row; nothing is shuffled.

    Only ``doc_id`` and ``text`` are read, texts whole.  A null or empty text has no words, bases or spans.  Equal rows
    get equal results; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))
    own = base.only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(_scan(shared), SCHEMA)


def op1(spark, sf_dir):
    names = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*columns))), ",")
    return scanned(base.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("bases").cast("long").alias("n_base"),
        F.array_min("bases.start").alias("first_word"), F.array_max("bases.start").alias("last_word"),
        names(F.col("bases.label")).alias("base_labels"), names(F.col("bases.label"), F.col("spans.label")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
