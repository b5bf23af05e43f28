"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates are cut into windows of at most ``WIDTH`` words, texts into windows of the same widths at every word. Window and
template window that share a band of MinHash values meet; with ``BANDS`` bands of ``ROWS`` values a pair at similarity 0.8
meets with a probability above 0.9999. The met windows of a template in a text are taken together and the template is verified
around them, as far as its own length on both sides, so it may be interrupted: the share of its distinct shingles that
occur in a span must reach ``CONTAINMENT``. Windows without a single shingle of a template have
similarity 0 to all of them, so only the others are hashed.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.arrays import CHUNK, STEP, Words, chunks, mix, string_batches, words

SHINGLE = 5
WIDTH = 32
BANDS, ROWS = 16, 3
CONTAINMENT = 0.8
SEEDS = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS, np.uint64)

# Opening or notice texts by which licenses are recognised.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/"),
}


def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the texts of the data file beside this module: a line ``== name``, then the text."""
    parts = Path(__file__).with_name("license_texts.txt").read_text(encoding="utf-8").split("== ")[1:]
    return TEMPLATES | {name: text for name, _, text in (part.partition("\n") for part in parts)}


SPANS = "array<struct<license:string,word:int,n_words:int,containment:double>>"
SPANS_ARROW = pa.list_(pa.struct([("license", pa.string()), ("word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = hashes[:n].copy()
    for k in range(1, size):
        value = value * STEP + hashes[k:k + n]
    return mix(value)


def signature(sets: np.ndarray) -> np.ndarray:
    """Band keys of windows, given as rows of shingles: [window, band]."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b, np.uint64)
        for r in range(ROWS):
            key = mix(key * STEP + mix(sets ^ SEEDS[b * ROWS + r]).min(1))
        out[:, b] = key
    return out


class Library:
    """Templates by the shape of their windows: (shingle size, shingles in a window)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.length, self.shingles, self.size, self.often = [], [], [], []
        self.tables: dict[tuple[int, int], dict] = {}
        column = pa.array([templates[n] for n in self.names], pa.large_string())
        for part in chunks(column):
            found = words(part)
            for i in range(part.n):
                own = found.hash[found.first[i]:found.first[i + 1]]
                number = len(self.length)
                size = min(SHINGLE, max(1, len(own)))
                values = runs_of(own, size)
                self.length.append(len(own))
                self.size.append(size)
                self.shingles.append(np.unique(values))
                self.often.append(Counter(values.tolist()))
                if not len(values):
                    continue
                wide = min(len(values), WIDTH - SHINGLE + 1)
                starts = sorted({*range(0, len(values) - wide + 1, max(1, wide // 2)), len(values) - wide})
                table = self.tables.setdefault((size, wide), {"bands": {}, "known": []})
                table["known"].append(values)
                for start in starts:
                    for key in signature(values[None, start:start + wide])[0].tolist():
                        table["bands"].setdefault(key, []).append((number, start))
        for table in self.tables.values():
            table["known"] = np.unique(np.concatenate(table["known"]))
            table["keys"] = np.array(sorted(table["bands"]), np.uint64)


def known_marks(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, by a small bit table first."""
    table = np.zeros(1 << 16, bool)
    table[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(values & np.uint64(0xFFFF)).astype(np.int64)])
    out = np.zeros(len(values), bool)
    out[maybe] = np.isin(values[maybe], known)
    return out


def best_end(places: list[int], values: list[int], often: Counter, size: int, i: int, limit: int) -> tuple[int, int, int, int] | None:
    """The best span that begins with the i-th shingle and ends up to word ``limit``, as (-score, words, i, last shingle). Each
    shingle scores 1, or -1 where the span has it more often than the template, so that copies are not taken together."""
    seen: Counter = Counter()
    score, best = 0, None
    for j in range(i, min(len(places), i + 2 * often.total())):
        if places[j] + size > limit:
            break
        seen[values[j]] += 1
        score += 1 if seen[values[j]] <= often[values[j]] else -1
        if best is None or score > -best[0]:
            best = -score, places[j] + size - places[i], i, j
    return best


def tightest(places: list[int], values: list[int], often: Counter, size: int) -> Iterator[tuple[int, int, float]]:
    """(first word, end, containment) of the spans without overlap that reach ``CONTAINMENT``, from the places of shingles of a
    template in order; the highest score first, then the shortest span."""
    end = places[-1] + size
    heap = [found for i in range(len(places)) if (found := best_end(places, values, often, size, i, end))]
    heapq.heapify(heap)
    taken: list[tuple[int, int]] = []
    while heap:
        _, n, i, j = heapq.heappop(heap)
        first, at = places[i], bisect_right(taken, (places[i], 1 << 62))
        if at and taken[at - 1][1] > first:
            continue
        if at < len(taken) and taken[at][0] < first + n:
            if again := best_end(places, values, often, size, i, taken[at][0]):
                heapq.heappush(heap, again)
            continue
        share = len(set(values[i:j + 1])) / len(often)
        if share >= CONTAINMENT:
            insort(taken, (first, first + n))
            yield first, first + n, share


def scan(found: Words, library: Library) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, template, first word, words, containment) of the verified places."""
    left = found.left()
    by_size = {size: runs_of(found.hash, size) for size in {s for s, _ in library.tables}}
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (size, wide), table in library.tables.items():
        values = by_size[size]
        whole = left[:len(values)] >= size
        marks = known_marks(values, table["known"]) & whole
        # windows that hold a known shingle and end within their text
        total = np.concatenate([[0], np.cumsum(marks)])
        n = len(values) - wide + 1
        if n <= 0:
            continue
        starts = np.flatnonzero((total[wide:] - total[:-wide] > 0)[:n] & (left[:n] >= size + wide - 1))
        for at in range(0, len(starts), 8192):
            some = starts[at:at + 8192]
            keys = signature(values[some[:, None] + np.arange(wide)])
            rows, bands = np.nonzero(np.isin(keys, table["keys"]))
            met = {(int(some[r]), number, start) for r, b in zip(rows, bands) for number, start in table["bands"][int(keys[r, b])]}
            for window, number, start in met:
                best.setdefault((int(found.text[window]), number), []).append((window - start, window - start + library.length[number]))
    for (text, number), met in sorted(best.items()):
        size, margin, often, values = library.size[number], library.length[number], library.often[number], by_size[library.size[number]]
        low, high = int(found.first[text]), int(found.first[text + 1])
        areas: list[list[int]] = []
        for first, end in sorted(met):
            if areas and first - margin <= areas[-1][1]:
                areas[-1][1] = max(areas[-1][1], end + margin)
            else:
                areas.append([first - margin, end + margin])
        spans = []
        for first, end in areas:
            first, end = max(first, low), min(end, high)
            near = values[first:max(first, end - size + 1)]
            hits = np.flatnonzero(np.isin(near, library.shingles[number]))
            if len(hits) and len(np.unique(near[hits])) >= CONTAINMENT * len(often):
                spans += tightest((first + hits).tolist(), near[hits].tolist(), often, size)
        for first, end, share in sorted(spans):
            yield text, number, first - low, end - first, share


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, licenses (names, sorted), spans (license, word, n_words, containment).

    ``templates`` (name to text) is a list that fits a task's memory; those without a word are never found. Templates of fewer
    than five words are one shingle. Null and empty texts have no words and no licenses. Repeated rows get repeated results.
    Overlapping places of one template count once, as the tightest span of the most shingles. Extra columns are not read.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    held: list[Library] = []

    @F.arrow_udf(f"n_words long, spans {SPANS}")
    def look(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(Library(chosen))
        counts, spans = [], []
        for part in chunks(string_batches(batch), CHUNK):
            found = words(part)
            rows: list[list[dict]] = [[] for _ in range(part.n)]
            for text, number, word, n, share in scan(found, held[0]):
                rows[text].append({"license": held[0].names[number], "word": word, "n_words": n, "containment": share})
            counts += found.counts.tolist()
            spans += [sorted(r, key=lambda s: (s["word"], s["license"])) for r in rows]
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, SPANS_ARROW)], ["n_words", "spans"])

    found = docs.select("doc_id", look(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")
    return found.select("doc_id", "n_words", F.array_sort(F.array_distinct(F.col("spans.license"))).alias("licenses"), "spans")
