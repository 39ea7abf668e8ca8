"""License scans by MinHash bands over overlapping windows.

For each length L of a template, texts are cut into windows of 3 L words that begin every L words, so
a notice of that length lies in one of them whole, even if other words, L in all at most, are put into it.
There its similarity to the window by shingles of three words is at least a fifth.  Each of ``BANDS``
bands is one MinHash value, so it is missed with a probability of (1 - 0.2) ** 64 = 6e-7 at most.
Templates of one shingle are retrieved by the shingle itself.  Retrieved templates are verified by exact
containment of their shingles in the window, and each stretch of the window that contains them is a match.
Matches that overlap, of one license or of several, give way to the one that contains most.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import ALNUM, Words, mix, quoted, text_slices

SHINGLE, BANDS = 3, 64
#: Share of a template's shingles that a window must contain; short templates must be there whole.
CONTAINED, SHORT = 0.8, 8
#: Words of a window, and from one window to the next, as multiples of the template's words.
SPAN = 3

# Notices of public licenses, (name, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Reserved", "All rights reserved."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
]

# Names of licenses on SPDX lines.
SPDX = """0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0
EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
MIT MIT-0 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL PSF-2.0 Unlicense Vim WTFPL Zlib""".split()
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]

FOUND = "array<struct<license:string,contained:double,first_word:bigint,end_word:bigint>>"
#: Most bytes of a library of templates.
TEMPLATE_BYTES = 32 << 20
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _shingles(text: str) -> tuple[np.ndarray, int]:
    flat = np.frombuffer(text.encode(), np.uint8)
    words = Words(flat, np.array([0, len(flat)]), ALNUM)
    return np.unique(words.grams(SHINGLE)), len(words.start)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The ``BANDS`` MinHash values of a set that isn't empty."""
    return mix(shingles[None, :] ^ _SEEDS[:, None]).min(1)


class Library:
    """Templates by length and band value."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names, self.sets, self.words = [], [], []
        self.single: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in templates:
            shingles, n_words = _shingles(text)
            if not len(shingles):
                raise ValueError(f"the template of {name} has fewer than {SHINGLE} words")
            for band, value in enumerate(minhashes(shingles).tolist()):
                self.bands[n_words][band, value].append(len(self.names))
            if len(shingles) == 1:
                self.single[n_words][int(shingles[0])].append(len(self.names))
            self.names.append(name)
            self.sets.append(shingles)
            self.words.append(n_words)
        self.all = np.unique(np.concatenate(self.sets))

    def scan(self, words: Words) -> dict[int, dict[str, tuple[float, int, int]]]:
        """{row: {license: (contained, first word, end word)}}, the best match of each license in each text."""
        best: dict[int, dict] = defaultdict(dict)
        for i, found in self.matches(words).items():
            for name, *m in sorted(found, key=lambda m: -m[1]):
                best[i].setdefault(name, tuple(m))
        return best

    def matches(self, words: Words) -> dict[int, list[tuple[str, float, int, int]]]:
        """{row: [(license, contained, first word, end word)]}, none overlapping another, in their order in the text."""
        out = {}
        for i, found in self.occurrences(words).items():
            # of matches that overlap the one that contains more stays, of equal ones the longer
            every = [(share, a, b, name) for name, ms in found.items() for share, a, b in ms]
            out[i] = sorted(((name, share, a, b) for share, a, b, name in _apart(every)), key=lambda m: (m[2], m[0]))
        return out

    def occurrences(self, words: Words) -> dict[int, dict[str, list[tuple[float, int, int]]]]:
        """{row: {license: [(contained, first word, end word)]}}, matches that don't overlap, the best first."""
        grams = words.grams(SHINGLE)
        # a window without any shingle of any template shares no band with one: only the others are hashed
        near = np.flatnonzero(self.all[np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)] == grams)
        near = near[words.row[near] == words.row[near + SHINGLE - 1]]
        base = np.concatenate([[0], np.cumsum(words.counts)])
        out: dict[int, dict[str, set[tuple[float, int, int]]]] = defaultdict(lambda: defaultdict(set))
        for length, bands in self.bands.items():
            row = words.row[near]
            block = (near - base[row]) // length
            for i, k in sorted({key for back in range(SPAN) for key in zip(row.tolist(), np.maximum(block - back, 0).tolist(), strict=True)}):
                begin = base[i] + k * length
                end = min(begin + SPAN * length, base[i + 1])
                own = grams[begin : max(begin, end - SHINGLE + 1)]
                if len(own):
                    self._verify(own, int(begin - base[i]), length, out[i])
        return {i: {name: _apart(m) for name, m in found.items()} for i, found in out.items() if found}

    def _verify(self, own: np.ndarray, begin: int, length: int, found: dict[str, set[tuple[float, int, int]]]) -> None:
        retrieved = {t for key in enumerate(minhashes(own).tolist()) for t in self.bands[length].get(key, ())}
        if length in self.single:
            retrieved |= {t for key in own.tolist() for t in self.single[length].get(key, ())}
        for t in retrieved:
            hits = np.flatnonzero(np.isin(own, self.sets[t]))
            size = len(self.sets[t])
            contained, least = len(np.unique(own[hits])) / size, CONTAINED if size > SHORT else 1.0
            if contained >= least:
                # a shingle that comes again ends a stretch that is a match, or takes the place of the stray one before
                stretches, last = [[]], []
                for k in hits.tolist():
                    keys = own[last]
                    if own[k] in keys:
                        if len(last) >= least * size:
                            stretches.append([])
                            last = []
                        else:
                            last = last[int(np.flatnonzero(keys == own[k])[0]) + 1 :]
                    last = [*last, k]
                    stretches[-1] = last
                parts = [(len(p) / size, p) for p in stretches if len(p) >= least * size] or [(contained, hits.tolist())]
                found[self.names[t]] |= {(share, begin + p[0], begin + p[-1] + SHINGLE) for share, p in parts}


def _apart(matches: Iterable[tuple]) -> list[tuple]:
    """The best matches (contained, first word, end word, ...), as far as they don't overlap a better one."""
    out, starts = [], []
    for m in sorted(matches, key=lambda m: (-m[0], m[1] - m[2], *m[1:])):
        at = bisect(starts, (m[1], m[2]))
        if (at == 0 or starts[at - 1][1] <= m[1]) and (at == len(starts) or starts[at][0] >= m[2]):
            starts.insert(at, (m[1], m[2]))
            out.append(m)
    return out


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(license, text) of the files of a folder, named by license: a library of whole license texts.

    Such libraries have some hundreds of texts; more than ``TEMPLATE_BYTES`` in all are an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    if (files.agg(F.sum(F.octet_length("value"))).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError(f"more than {TEMPLATE_BYTES} bytes of license texts in {path}")
    return [(r["name"], r["value"]) for r in files.orderBy("name").collect()]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, found): the license notices that each text contains, in their order.

    A null or empty text has none; a null doc_id is kept; repeated rows are scanned each; an empty table gives no rows; other
    columns are not looked at.  The templates are a short list, sent to every task.
    """
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("contained", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            for row, end, flat, at in text_slices(batch.column(1)):
                hits = library.matches(Words(flat, at, ALNUM))
                found = [[dict(zip(("license", "contained", "first_word", "end_word"), m, strict=True)) for m in hits.get(i, ())] for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select("doc_id", quoted(text).alias("__text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, found {FOUND}")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (names, comma-joined) and matches (license:first word:end word)."""
    rows = scan_licenses(docs)
    placed = F.array_sort(F.transform("found", lambda m: F.struct(m["license"].alias("l"), m["first_word"].alias("a"), m["end_word"].alias("b"))))
    match = F.transform(placed, lambda m: F.concat_ws(":", m["l"], m["a"], m["b"]))
    names = F.array_sort(F.array_distinct("found.license"))
    return rows.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(match, ",").alias("matches"))
