"""License scans by patience alignment of texts with license templates.

Text and template are words.  A pair is anchored on words that are unique in
both, the longest increasing subsequence of anchors is kept, and the gaps
between anchors are aligned in turn; a gap without unique words is aligned by
its common ends.  Coverage is the share of template words so aligned; a license
is reported from ``COVERAGE`` up.

Whole texts are searched: blocks of twice the template's length, each begun a
quarter of a length after the last, so a notice that inserted words stretch to
one and three quarters of its length lies whole in one block wherever it begins.
A block is aligned only if enough of its words are the template's, which is an
upper bound of coverage and loses nothing.

Defined cases: null, empty and wordless texts have no license; of blocks with
equal coverage the first counts; equal coverages list licenses by name; repeated
rows each get their result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import keep

COVERAGE = 0.8
#: Blocks that begin within a template's length.
STEPS = 4
#: Notices and texts of common licenses, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[T.Spans, np.ndarray]:
    data = T.LOWER[data]
    spans = T.runs(data, offsets, T.PLAIN)
    return spans, T.hashes(T.prefix_sums(data), spans.starts, spans.ends, data)


def template_words(templates: dict[str, str]) -> dict[str, list[int]]:
    out = {}
    for name, text in sorted(templates.items()):
        data, offsets = T.buffers(pa.array([text]))
        out[name] = _word_hashes(data, offsets)[1].tolist()
    return out


def align(a: list, b: list, a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Pairs of equal places of a and b, increasing in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    work = [(a0, len(a) if a1 is None else a1, b0, len(b) if b1 is None else b1)]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        # longest increasing subsequence of the places in b
        tails: list[int] = []
        top: list[int] = []
        back = [-1] * len(anchors)
        for k, (_, j) in enumerate(anchors):
            pile = bisect_left(tails, j)
            if pile == len(tails):
                tails.append(j)
                top.append(k)
            else:
                tails[pile], top[pile] = j, k
            back[k] = top[pile - 1] if pile else -1
        chain, k = [], top[-1] if top else -1
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        if not chain:
            continue
        chain.reverse()
        out += chain
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False) if k > i + 1 and m > j + 1]
    return sorted(out)


def find(words: list[int], templates: dict[str, list[int]], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """Licenses of a text's word hashes: name, coverage, first and end word of the best stretch."""
    found = []
    for name, template in templates.items():
        n = len(template)
        count = Counter(template)
        inside = np.fromiter((w in count for w in words), bool, len(words))
        total = np.concatenate([[0], np.cumsum(inside)])
        best = None
        starts = np.arange(0, len(words) if n else 0, max(1, n // STEPS))
        stops = np.minimum(starts + 2 * n, len(words))
        rich = np.flatnonzero(total[stops] - total[starts] >= coverage * n)
        for start, stop in zip(starts[rich].tolist(), stops[rich].tolist(), strict=True):
            block = words[start:stop]
            bound = Counter(w for w in block if w in count)
            if sum(min(k, count[w]) for w, k in bound.items()) < coverage * n:
                continue
            pairs = align(block, template)
            if len(pairs) >= coverage * n and (best is None or len(pairs) > best[0]):
                best = len(pairs), start + pairs[0][0], start + pairs[-1][0] + 1
        if best:
            found.append((name, best[0] / n, best[1], best[2]))
    return sorted(found, key=lambda f: (-f[1], f[0]))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words and licenses (name, coverage, first and end word; best first) of each row."""
    spark = documents.sparkSession
    wanted = template_words(TEMPLATES if templates is None else templates)
    wanted = {k: v for k, v in wanted.items() if v}
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(wanted)
        vocabulary = np.unique(np.array([w for v in wanted.values() for w in v], np.uint64))
        weight = np.zeros((len(vocabulary), len(names)))
        for k, v in enumerate(wanted.values()):
            np.add.at(weight[:, k], np.searchsorted(vocabulary, np.array(v, np.uint64)), 1 / len(v))
        for batch in batches:
            for i, j, data, offsets in T.pieces(batch.column("text")):
                spans, h = _word_hashes(data, offsets)
                at = np.searchsorted(vocabulary, h)
                at[at == len(vocabulary)] = 0
                hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                present = np.zeros((j - i, len(vocabulary)), bool)
                present[spans.rows()[hit], at[hit]] = True
                able = present @ weight >= coverage - 1e-9
                out: list[list[dict]] = [[] for _ in range(j - i)]
                for r in np.flatnonzero(able.any(1)).tolist():
                    got = find(h[spans.row[r] : spans.row[r + 1]].tolist(), {names[k]: wanted[names[k]] for k in np.flatnonzero(able[r])}, coverage)
                    out[r] = [{"license": n, "coverage": c, "first": a, "end": b} for n, c, a, b in got]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(spans.count.astype(np.int64)), pa.array(out, kind)], names=["doc_id", "n_words", "licenses"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(docs.mapInArrow(run, "doc_id bigint, n_words bigint, licenses array<struct<license:string,coverage:double,first:int,end:int>>"), "licenses")
