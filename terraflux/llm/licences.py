"""Operator 5. License scans by winnowed fingerprints and banded alignment.

Templates are split into words (runs of ASCII letters and digits, other letters as they
are, lower case). Hashed word k-grams of a template are winnowed: of every window of
k-grams the least is kept, so any run of ``k + window - 1`` template words in a document
holds a kept one. Both numbers follow from the template's length: a match of the least
coverage must leave a run that long between the words it lacks (``seeds``), so a short
notice is looked up by shorter runs, and all of them. The kept fingerprints form an
inverted index from hash to (template, position). A document's k-grams are looked up in
it; hits of a template on nearby diagonals are one candidate, which is aligned with the
template inside a band. Matched words over template words is the coverage.

The templates are a parameter of fixed size, so the index travels with the task; no
documents are moved.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 3, 2  # the most words of a k-gram, and the most k-grams of a window
_SCORE = (1, -1, -1)  # match, mismatch, gap

#: Public licence notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def seeds(n: int, least: float) -> tuple[int, int]:
    """Words of a k-gram, and k-grams of a window, for a template of n words.

    A match may lack m words of the template, which leave a run of at least (n - m) / (m + 1).
    """
    m = n - math.ceil(least * n - 1e-9)
    run = max(1, -(-(n - m) // (m + 1)))
    gram = min(GRAM, run)
    return gram, min(WINDOW, run - gram + 1)


def gram_hashes(words: list[bytes] | np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all runs of ``gram`` words, or of the words' own hashes."""
    h = words if isinstance(words, np.ndarray) else np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(0, len(words) - gram + 1)
    out = np.zeros(n, np.uint64)
    for j in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    return out ^ (out >> np.uint64(31))


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions kept: the last least hash of each window."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (np.arange(len(views)) + views.argmin(axis=1)))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """The best alignment of a template with a stretch of ``words`` near a diagonal.

    The stretch may begin and end anywhere; (score, matched words, first word, word after
    the last). Cell (i, j) of the band stands for word ``i + diagonal - band + j``.
    """
    match, mismatch, gap = _SCORE
    width = 2 * band + 1
    at = np.arange(width)
    score, matched, begin = np.zeros(width, np.int64), np.zeros(width, np.int64), at + diagonal - band
    for i, t in enumerate(template):
        where = i + diagonal - band + at
        inside = (where >= 0) & (where < len(words))
        same = inside & (words[np.clip(where, 0, len(words) - 1)] == t)
        across = np.where(inside, score + np.where(same, match, mismatch), -(1 << 30))
        up = np.append(score[1:], -(1 << 30)) + gap  # the template word has no partner
        take = across >= up
        base = np.where(take, across, up)
        m = np.where(take, matched + same, np.append(matched[1:], 0))
        b = np.where(take, begin, np.append(begin[1:], 0))
        # a word of the text without a partner moves along the row; the running best does it in one pass
        lifted = base - gap * at
        best = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == best, at, 0))
        score, matched, begin = best + gap * at, m[source], b[source]
    k = int(np.lexsort((at, -matched, -score))[0])
    return int(score[k]), int(matched[k]), int(begin[k]), min(len(template) + diagonal - band + k, len(words))


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches (score, matched words, begin, end) that don't overlap, by begin: the better score first, then the earlier."""
    begins, ends, by = [], [], {}
    for x in sorted(found, key=lambda x: (-x[0], x[2], x[3])):
        at = bisect.bisect_right(begins, x[2])
        if (at == 0 or ends[at - 1] <= x[2]) and (at == len(begins) or begins[at] >= x[3]):
            begins.insert(at, x[2])
            ends.insert(at, x[3])
            by[x[2]] = x
    return [by[b] for b in begins]


class Index:
    """The inverted index of a set of templates."""

    def __init__(self, templates: dict[str, str], least: float = 0.8):
        self.names, self.least = list(templates), least
        self.words = [words_of(t) for t in templates.values()]
        held: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(self.words):
            if words:
                gram, window = seeds(len(words), least)
                h = gram_hashes(words, gram)
                for at in winnowed(h, window):
                    held[gram][int(h[at])].append((k, int(at)))
        self.at = {gram: (np.array(sorted(x), np.uint64), dict(x)) for gram, x in held.items()}
        code = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.code = code
        self.coded = [np.array([code[w] for w in ws]) for ws in self.words]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int, int, int]]:
        """Matches: template, coverage, matched words, first and last word, first character and the one after the last."""
        words = words_of(text or "")
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        near = defaultdict(set)
        for gram, (keys, places) in self.at.items():
            h = gram_hashes(own, gram)
            for at in np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h).tolist():
                for k, p in places[int(h[at])]:
                    near[k].add(at - p)
        if not near:
            return []
        coded = np.fromiter((self.code.get(w, -1) for w in words), np.int64, len(words))
        out = []
        for k in sorted(near):
            template = self.coded[k]
            band = max(2, len(template) // 5)
            found = []
            last = None
            for diagonal in sorted(near[k]):
                if last is not None and diagonal - last <= band // 2:
                    continue  # inside the band aligned already
                last = diagonal
                score, matched, begin, end = align(template, coded, diagonal, band)
                if matched >= self.least * len(template) - 1e-9:
                    found.append((score, matched, begin, end))
            out += [(self.names[k], m / len(template), m, b, e - 1) for _, m, b, e in apart(found)]
        return _with_characters(text, out)


def _with_characters(text: str, found: list[tuple]) -> list[tuple]:
    """Adds the characters of word spans."""
    if not found:
        return []
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) > 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(*x, int(chars[begin[x[3]]]) - 1, int(chars[end[x[4]] - 1])) for x in found]


MATCH = "doc_id long, license string, coverage double, matched_words int, first_word int, last_word int, first_char long, end_char long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row for each match that covers ``least`` of a template: coverage and spans.

    Whole texts are searched. Matches of one template don't overlap: the better score
    stays, then the earlier. Null, empty or wordless texts match nothing; a null doc_id
    is kept; repeated rows match each for itself; very long texts are read whole; extra
    columns are ignored; an empty table gives an empty result.
    """
    index = Index(TEMPLATES if templates is None else templates, least)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), *[(n, pa.int32()) for n in ("matched_words", "first_word", "last_word")], ("first_char", pa.int64()), ("end_char", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in index.scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, MATCH)
