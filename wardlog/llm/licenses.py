"""License scans: template shingles pick candidates, banded alignment reports coverage and spans.

Templates are cut into shingles of three words, which go into an inverted index. A document is read once for shingles made of
template words only; hits in the index vote for (template, diagonal), and each candidate is aligned word by word within a band
around its diagonal. The words of the matches are set aside and the rest is aligned again until no match is left, so that
notices close to each other are all found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import rows_out, slices

SHINGLE, BAND = 3, 8
MIN_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")
#: Template texts (fixed values): short notices, headers and grants as they are published.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Proprietary": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                 "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                 "Software is furnished to do so, subject to the following conditions",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                  "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


class LicenseIndex:
    """Inverted index over template shingles, and the alignment of candidates."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES):
        self.names = list(templates)
        self.words = [WORD.findall(t.lower()) for t in templates.values()]
        self.ids: dict[str, int] = {}
        for words in self.words:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        base = self.base = len(self.ids) + 1
        if base**SHINGLE >= 1 << 62:
            raise ValueError("too many different words in the templates")
        posting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            coded = [self.ids[w] for w in words]
            grams = [self._code(coded[k : k + SHINGLE]) for k in range(len(coded) - SHINGLE + 1)]
            for k, gram in enumerate(grams):
                posting[gram].append((t, k))
        self.posting = dict(posting)
        self.codes = np.array(sorted(posting), np.int64)

    def _code(self, gram: list[int]) -> int:
        code = 0
        for w in gram:
            code = code * self.base + w
        return code

    def matches(self, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, float, int, int, list[tuple[int, int]]]]:
        """(license, coverage, start, end, matched word spans) in characters of the text, best first; overlapping worse ones are left out."""
        if not text:
            return []
        get = self.ids.get
        coded = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
        if len(coded) < SHINGLE:
            return []
        code = np.zeros(len(coded) - SHINGLE + 1, np.int64)
        whole = np.ones(len(code), bool)
        for k in range(SHINGLE):
            part = coded[k : k + len(code)]
            code = code * self.base + part
            whole &= part > 0
        hits = np.flatnonzero(whole)
        hits = hits[np.isin(code[hits], self.codes)]
        if not hits.size:
            return []
        spans = [m.span() for m in WORD.finditer(text)] if len(text.lower()) == len(text) else None
        if spans is None or len(spans) != len(coded):
            spans = [m.span() for m in WORD.finditer("".join(c.lower() if len(c.lower()) == 1 else c for c in text))]
        out = []
        free = coded.copy()  # words of matches become zero, and the rest is aligned again until nothing is found
        while hits.size:
            found = self._candidates(free, hits, code, min_coverage)
            found.sort(key=lambda f: (-f[0] * f[1], -f[0], self.names[f[2]], f[3]))
            taken: set[int] = set()
            for coverage, _, t, places in found:
                if not taken.intersection(places):
                    taken.update(places)
                    inside = [p for p in places if p < len(spans)]
                    if inside:
                        out.append((self.names[t], coverage, spans[inside[0]][0], spans[inside[-1]][1], [spans[p] for p in inside]))
            if not taken:
                break
            free[list(taken)] = 0
            hits = hits[(free[hits] > 0) & (free[hits + 1] > 0) & (free[hits + 2] > 0)]
        return sorted(out, key=lambda m: (m[2], m[3], m[0]))

    def _candidates(self, coded: np.ndarray, hits: np.ndarray, code: np.ndarray, min_coverage: float) -> list[tuple[float, int, int, list[int]]]:
        """(coverage, template words, template, places of the matched words) of every place to which a hit leads; each place once."""
        seeds: dict[int, set[int]] = defaultdict(set)
        for p in hits.tolist():
            for t, k in self.posting[int(code[p])]:
                seeds[t].add(p - k)
        found = {}
        for t, starts in seeds.items():
            size = len(self.words[t])
            known = np.concatenate(([0], np.cumsum(np.isin(coded, [self.ids[w] for w in self.words[t]]))))
            for start in sorted(starts):
                # no alignment matches more words than the band has words of the template
                if known[min(len(coded), start + size + BAND)] - known[max(0, start - BAND)] < min_coverage * size:
                    continue
                pairs = self._align(t, coded, start)
                if pairs and len(pairs) / size >= min_coverage:
                    places = [p for p, _ in pairs]
                    found[t, tuple(places)] = (len(pairs) / size, size, t, places)
        return list(found.values())

    def _align(self, t: int, coded: np.ndarray, start: int) -> list[tuple[int, int]]:
        """Matched (document word, template word) pairs of the best alignment within the band, of equal ones the nearest to
        its middle; the document's ends are free."""
        template = [self.ids[w] for w in self.words[t]]
        low, high = max(0, start - BAND), min(len(coded), start + len(template) + BAND)
        window = coded[low:high].tolist()
        shift = start - low
        n, m = len(window), len(template)
        best = {}
        from_ = {}
        for j in range(m + 1):
            for i in range(max(0, j + shift - BAND), min(n, j + shift + BAND) + 1):
                if j == 0 or i == 0:
                    best[i, j] = (0.0, 0)
                    continue
                options = []
                if (i - 1, j - 1) in best:
                    s, c = best[i - 1, j - 1]
                    same = window[i - 1] == template[j - 1]
                    options.append((s + (1.0 if same else -0.4), c + same, 0 if same else 1))
                if (i, j - 1) in best:
                    options.append((best[i, j - 1][0] - 0.4, best[i, j - 1][1], 2))
                if (i - 1, j) in best:
                    options.append((best[i - 1, j][0] - (0.4 if j < m else 0.0), best[i - 1, j][1], 3))
                s, c, how = max(options, key=lambda o: (o[0], -o[2]))
                best[i, j], from_[i, j] = (s, c), how
        ends = [(best[i, j][0], -abs(i - shift - m), -i, i, j) for i, j in best if j == m]
        if not ends:
            return []
        _, _, _, i, j = max(ends)
        pairs = []
        while (i, j) in from_:
            how = from_[i, j]
            if how == 0:
                pairs.append((low + i - 1, j - 1))
            i, j = (i - 1, j - 1) if how < 2 else (i, j - 1) if how == 2 else (i - 1, j)
        return pairs[::-1]


def license_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per match: id, license, coverage, start, end, spans (matched words), in characters of the text.

    Case, punctuation and line breaks do not matter. Places that overlap a better match are left out; a document without a
    match gives no row. Null and empty texts match nothing. Repeated rows each give their rows; other columns are not read.
    The index has the size of the templates (a parameter). No shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    index = LicenseIndex(templates)
    kind = docs.schema[id_col].dataType
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("spans", pairs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                for name, coverage, start, end, spans in index.matches(text, min_coverage):
                    for column, value in zip(out, (doc, name, coverage, start, end, [{"start": a, "end": b} for a, b in spans]), strict=True):
                        column.append(value)
            yield rows_out(arrow, out)

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind.simpleString()}, license string, coverage double, start int, end int, spans array<struct<start: int, end: int>>")
