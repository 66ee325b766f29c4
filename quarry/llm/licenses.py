"""License scans by patience alignment of texts with license templates.

A text that holds enough of a template's distinct words is cut where more than `MAX_GAP` words in a row are none of the
template's; each place of the template lies within one such region. There, words that occur once in both sides are
anchors; the longest increasing subsequence of their places is kept, and the gaps between are aligned in
the same way (where no word is unique, by common beginnings and ends). Around a verbatim copy found so, and in regions
without one, chains are searched: words in the template's order with at most `MAX_GAP` words between two of them,
from left to right; a chain that is long enough grows while longer ones end within that gap, and the next begins behind
it. Coverage is the share of the template's words in the chain; from `min_coverage` up it is a hit, with its character
offsets.

Words are runs of letters and digits, in lower case. Null and empty texts have no hit. Empty tables give no
rows, repeated rows are each scanned, extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import groups, spans, text_buffers, word_hashes

#: Short public license notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT notice": "Released under the MIT License",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC BY-NC notice": "Licensed under CC BY-NC 4.0",
    "CC BY-SA notice": "Licensed under CC BY-SA 4.0",
    "CC BY notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Reserved": "All rights reserved",
}
MAX_GAP = 6
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
DDL = "doc_id long, license string, coverage double, start int, end int"


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v), at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _unique(words: list[int], lo: int, hi: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(lo, hi):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places in a and b with equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        ours, theirs = _unique(a, alo, ahi), _unique(b, blo, bhi)
        anchors = sorted((i, theirs[w]) for w, i in ours.items() if w in theirs)
        anchors = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if anchors:
            for (i0, j0), (i1, j1) in zip([(alo - 1, blo - 1), *anchors], [*anchors, (ahi, bhi)]):
                todo.append((i0 + 1, i1, j0 + 1, j1))
            out += anchors
    return sorted(out)


def _best_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose places in the text have small gaps."""
    best, run = [], []
    for p in pairs:
        if run and p[1] - run[-1][1] > MAX_GAP + 1:
            run = []
        run.append(p)
        if len(run) > len(best):
            best = list(run)
    return best


def _chain(words: list[int], lo: int, hi: int, at: dict[int, list[int]], needed: int) -> tuple[int, int, int] | None:
    """Length and first and last word of the first chain of at least `needed` words."""
    recent: deque[tuple[int, int, int, int]] = deque()  # last word, template place, length and first word of chains that can grow
    best = None
    for j in range(lo, hi):
        if best and j - best[2] > MAX_GAP + 1:
            break
        while recent and j - recent[0][0] > MAX_GAP + 1:
            recent.popleft()
        new = []
        for p in at.get(words[j], ()):
            length, first = max(((n, s) for _, q, n, s in recent if q < p), default=(0, j))
            new.append((j, p, length + 1, first))
        for _, _, length, first in new:
            if length >= needed and (best is None or length > best[0]):
                best = length, first, j
        recent += new
    return best


def hits(words: list[int], template: list[int], min_coverage: float) -> list[tuple[float, int, int]]:
    """Coverage and first and last word of each place of the template in a text."""
    at: dict[int, list[int]] = {}
    for p, w in enumerate(template):
        at.setdefault(w, []).append(p)
    needed = max(1, int(np.ceil(min_coverage * len(template) - 1e-9)))
    places = [i for i, w in enumerate(words) if w in at]
    cuts = [0, *[k for k in range(1, len(places)) if places[k] - places[k - 1] > MAX_GAP + 1], len(places)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < needed:
            continue
        lo, hi = places[a], places[b - 1] + 1
        run = _best_run(align(template, words[lo:hi]))
        parts = [(lo, hi)]
        if len(run) == len(template) == run[-1][1] - run[0][1] + 1:
            x, y = lo + run[0][1], lo + run[-1][1]
            out.append((1.0, x, y))
            parts = [(lo, x), (y + 1, hi)]
        for lo, hi in parts:
            while hi - lo >= needed and (found := _chain(words, lo, hi, at, needed)):
                out.append((found[0] / len(template), found[1], found[2]))
                lo = found[2] + 1
    return sorted(out, key=lambda h: h[1])


def _words(texts: list[str]) -> list[list[int]]:
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    starts, ends, first = spans(data[offsets[0] : offsets[-1]], offsets, _GAP)
    h = word_hashes(data, starts, ends).tolist()
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each place of a license template in a text."""
    templates = TEMPLATES if templates is None else templates
    names = [n for n in templates if templates[n].split()]
    shapes = _words([templates[n] for n in names])
    vocabulary = np.unique(np.array(sorted({w for s in shapes for w in s}), dtype=np.uint64))
    held = np.array([[w in set(s) for s in shapes] for w in vocabulary.tolist()], dtype=np.int32).reshape(len(vocabulary), len(shapes))
    enough = np.array([max(1, len(set(s)) - (len(s) - int(np.ceil(min_coverage * len(s) - 1e-9)))) for s in shapes])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows: list[tuple] = []
            for lo, hi in groups(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = spans(part, own, _GAP)
                h = word_hashes(part, starts, ends)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, int)
                has = np.zeros((hi - lo, len(vocabulary)), dtype=np.int32)
                has[np.searchsorted(first, known, side="right") - 1, at[known]] = 1
                for k, j in zip(*np.nonzero(has @ held >= enough)):
                    a, b = first[k], first[k + 1]
                    for coverage, x, y in hits(h[a:b].tolist(), shapes[j], min_coverage):
                        begin = len(part[own[k] : starts[a + x]].tobytes().decode(errors="ignore"))
                        rows.append((batch.column("doc_id")[lo + k].as_py(), names[j], coverage, begin, begin + len(part[starts[a + x] : ends[a + y]].tobytes().decode(errors="ignore"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()))], names=["doc_id", "license", "coverage", "start", "end"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, DDL)
