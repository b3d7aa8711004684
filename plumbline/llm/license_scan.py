"""License scans: an exact containment join of blocks of text with license templates.

Blocks are windows of 48 words, one every 24 words, so that any notice of up to 25 words lies in one; longer templates have blocks of
their own, as much larger as they need. A block meets a template when it holds at least 80 % of the template's distinct words. Tokens are put in order by the number of blocks of the whole corpus
that hold them, rare first. Only words of templates can be common to a block and a template, so blocks are cut to those (exact).
A block can meet a template only if it holds one of its first n - need + 1 words in that order (prefix filter), has need such
words at all (length filter), and has enough words left from the first common one on (positional filter); those that pass are
compared as sets.

Templates are a fixed parameter; their index goes to every task. Each row is scanned on its own, so no key can be hot.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows get equal rows each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import NOT_ALNUM, U, Words, words

#: A block starts every STEP words, or a doubling of that for longer templates, and is twice as long.
STEP, PERCENT = 24, 80

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of up to 25 words each, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher"),
]


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), NOT_ALNUM).hashes()


def step_of(n: int) -> int:
    """Between blocks for a template of n words: one that stands in one piece lies in a block, wherever it starts."""
    step = STEP
    while step + 1 < n:
        step *= 2
    return step


def blocks_of(n: int, step: int = STEP) -> list[tuple[int, int]]:
    """Words from, to of the blocks of a text of n words."""
    return [(k, min(n, k + 2 * step)) for k in range(0, max(1, n - step), step)] if n else []


class Index:
    """Templates as sets of word numbers (their places in the order), and the inverted index of their prefixes. All have blocks of one size."""

    def __init__(self, templates: list[tuple[str, str]], step: int, percent: int = PERCENT):
        self.step, self.block = step, 2 * step
        sets = [np.unique(_hashes(x)) for _, x in templates]
        self.vocabulary = np.unique(np.concatenate(sets))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & U(0xFFFF)).astype(np.int64)] = True
        self.sets = [np.searchsorted(self.vocabulary, x) for x in sets]
        self.need = [-(-percent * len(x) // 100) for x in sets]
        self.order(np.zeros(len(self.vocabulary), np.int64))

    def order(self, counts: np.ndarray) -> None:
        """Puts the words in order by these counts, rare first (ties by hash)."""
        self.place = np.empty(len(counts), np.int64)
        self.place[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.sorted = [sorted(self.place[x].tolist()) for x in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, x in enumerate(self.sorted):
            for i, word in enumerate(x[: len(x) - self.need[t] + 1]):
                self.prefix.setdefault(word, []).append((t, i))
        self.starts = np.zeros(len(counts), bool)
        self.starts[list(self.prefix)] = True

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, number): where words of the vocabulary stand, and which they are."""
        at = np.flatnonzero(self.maybe[(h & U(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[k] == h[at]
        return at[same], k[same]

    def matches(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of the templates that a block (sorted distinct places) meets."""
        out, tried, have = [], set(), set(block)
        for j, word in enumerate(block):
            for t, i in self.prefix.get(word, ()):
                if t in tried:
                    continue
                tried.add(t)  # the first common word in the order: what both have from here on bounds the overlap
                x, need = self.sorted[t], self.need[t]
                if len(block) >= need and min(len(x) - i, len(block) - j) >= need:
                    common = sum(w in have for w in x)
                    if common >= need:
                        out.append((t, common / len(x)))
        return out


    def found(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, template, from word, to word, containment) of the blocks of texts that meet templates. h: the words' hashes; first: where texts start."""
        at, number = self.known(h)
        place = self.place[number]
        hot = at[self.starts[place]]
        for d in np.unique(np.searchsorted(first, hot, "right") - 1).tolist():
            a, b = first[d], first[d + 1]
            i, j = np.searchsorted(at, [a, b])
            inside, which = at[i:j] - a, place[i:j]
            last = max(0, -(-(int(b - a) - self.block) // self.step))
            step = np.minimum(inside[self.starts[which]] // self.step, last)
            for k in (np.unique(np.concatenate([step, np.maximum(step - 1, 0)])) * self.step).tolist():
                x, y = np.searchsorted(inside, [k, k + self.block])
                for t, c in self.matches(np.unique(which[x:y]).tolist()):
                    yield d, t, k, min(int(b - a), k + self.block), c


def count_words(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many blocks of the corpus each word of the vocabulary stands; a task sends one row a word at most."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    size = len(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, sums = shared.value, np.zeros(size, np.int64)
        for batch in batches:
            for _, _, w in words(batch.column(0), NOT_ALNUM):
                at, number = ix.known(w.hashes())
                text = np.searchsorted(w.first, at, "right") - 1
                inside, last = at - w.first[text], np.diff(w.first)[text]
                # A word stands in the block that starts at its step, and in the one before.
                most = np.maximum(0, -(-(last - ix.block) // ix.step))
                step = np.minimum(inside // ix.step, most)
                own = (text * np.int64(1 << 32) + step) * size + number
                before = own[(step > 0) & (inside < (step - 1) * ix.step + ix.block)] - size
                sums += np.bincount(np.unique(np.concatenate([own, before])) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], ["word", "n"])

    out = np.zeros(size, np.int64)
    for k, n in docs.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        out[k] = n
    return out


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment; 1 with a base phrase), and
    found: (template, from_word, to_word, containment) of every block that meets a template."""
    own = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    sizes: dict[int, list[int]] = {}
    for t, (_, x) in enumerate(templates):
        if len(_hashes(x)):
            sizes.setdefault(step_of(len(_hashes(x))), []).append(t)
    indexes = [(numbers, Index([templates[t] for t in numbers], step)) for step, numbers in sorted(sizes.items())]
    for _, index in indexes:
        index.order(count_words(own, index))
    shared = docs.sparkSession.sparkContext.broadcast(indexes)
    phrases = [(_hashes(x), x.encode(), label) for x, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("template", pa.int32()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            for lo, hi, w in words(batch.column(0), NOT_ALNUM):
                h, n = w.hashes(), np.diff(w.first)
                places: list[list[tuple[int, str]]] = [[] for _ in n]
                for p, raw, label in phrases:
                    m = len(p)
                    at = np.flatnonzero(h[: max(0, len(h) - m + 1)] == p[0])
                    for i in range(1, m):
                        at = at[h[at + i] == p[i]]
                    for k, d in zip(at.tolist(), (np.searchsorted(w.first, at, "right") - 1).tolist(), strict=True):
                        if k + m <= w.first[d + 1] and w.bytes_of(k, k + m) == raw:
                            places[d].append((k - int(w.first[d]), label))
                found: list[list[tuple[int, int, int, float]]] = [[] for _ in n]
                for numbers, ix in shared.value:
                    for d, t, k, end, c in ix.found(h, w.first):
                        found[d].append((numbers[t], k, end, c))
                base = [sorted({x for _, x in p}) for p in places]
                every = [sorted({*b, *(templates[t][0] for t, *_ in f)}) for b, f in zip(base, found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min((k for k, _ in p), default=None) for p in places], pa.int64()), pa.array([max((k for k, _ in p), default=None) for p in places], pa.int64()),
                    pa.array([",".join(x) for x in base]), pa.array([",".join(x) for x in every]),
                    pa.array([1.0 if p else max((c for *_, c in f), default=0.0) for p, f in zip(places, found, strict=True)], pa.float64()),
                    pa.array([[dict(zip(("template", "from_word", "to_word", "containment"), x, strict=True)) for x in f] for f in found], kind),
                ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<template: int, from_word: bigint, to_word: bigint, containment: double>>")


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("found")


def brute_force(text: str | None, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[int, int, int | None, int | None, str, str, float]:
    """A row of report without its id: every block compared with every template; for tests."""
    split = lambda x: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").encode().lower())
    w = split(text)
    places = [(k, label) for x, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p := split(x))] == p]
    best, labels = 0.0, {x for _, x in places}
    for label, t in templates:
        own = split(t)
        for a, b in blocks_of(len(w), step_of(len(own))):
            c = len(set(w[a:b]) & set(own)) / len(set(own))
            if 100 * c >= PERCENT - 1e-9:
                best, labels = max(best, c), labels | {label}
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if places else best
