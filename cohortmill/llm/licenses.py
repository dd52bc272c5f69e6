"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Templates of about one length share a class. A class reads a text in windows of five steps, one begun at every step;
a step is a quarter of the class's shortest template, so some window holds any stretch as long as a template whole.
From the class's sizes follows the least Jaccard similarity of a window that holds 80 % of a template, and from that
the number of bands that makes a miss rarer than MISS. Only rows with as many of a class's shingles as a match needs are
read in its windows, so a long list of whole licenses costs little where there are none. Where versions or variants of one family
match at one place, the one with the greatest exact containment wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textbytes import SHINGLE, WORD_BYTES, mixed, with_arrow_columns, word_chunks

CONTAINMENT, MISS, BLOCKS = 0.8, 1e-6, 5
_MARKS = 1 << 20

# Notices of public licenses, as they are printed.
_NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("reserved", "All rights reserved."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "version 2 as published by the Free Software Foundation."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file "
                "except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
                "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
                "available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
                "software to the public domain worldwide. This software is distributed without any warranty."),
]
#: (name, GNU license, version, what it covers) of the notices that differ in these alone.
_GNU = [("GPL-1.0", "General", "1", "program"), ("GPL-2.0", "General", "2", "program"), ("GPL-3.0", "General", "3", "program"),
        ("LGPL-2.0", "Library General", "2", "library"), ("LGPL-2.1", "Lesser General", "2.1", "library"), ("LGPL-3.0", "Lesser General", "3", "library"),
        ("LGPL-2.1", "Lesser General", "2.1", "program"), ("LGPL-3.0", "Lesser General", "3", "program"), ("AGPL-3.0", "Affero General", "3", "program")]
_CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
                     "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_FAMILIES = {"LGPL": "GPL", "AGPL": "GPL", "0BSD": "ISC"}


def license_texts() -> list[tuple[str, str]]:
    """(license, text): the notices, and the whole texts in `license_texts`, which only the driver reads."""
    out = list(_NOTICES)
    for name, kind, version, what in _GNU:
        out.append((name, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as "
                          f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."))
        out.append((name, f"This work is licensed under the GNU {kind} Public License, version {version}."))
    for code, name in _CREATIVE_COMMONS.items():
        for version, scope in (("3.0", "Unported"), ("4.0", "International")):
            out.append((f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {name} {version} {scope} License."))
            out.append((f"CC-{code}-{version}", f"Licensed under CC {code} {version}."))
    out += [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return list(dict.fromkeys(out))


LICENSE_TEXTS = license_texts()


def family(name: str) -> str:
    """Licenses of one family are versions and variants of each other."""
    head = name.split("-")[0]
    return _FAMILIES.get(head, head)


def band_count(similarity: float, miss: float = MISS) -> int:
    """Bands of one hash each of which some meets with probability 1 - miss or more at this similarity."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


def run_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n words from each word on, the row's first one); only runs inside a row."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    places = np.random.default_rng(1_000 + n).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(n):
        total += words[k:k + count] * places[k]
    sizes = np.maximum(0, np.diff(first) - n + 1)
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(first[:-1], sizes)
    return mixed(total[at], n), np.concatenate([[0], ends])


@dataclass
class TemplateClass:
    """Templates of one shingle length and nearly one size."""

    n: int
    step: int
    bands: int
    ids: list[int]
    sets: list[np.ndarray]
    #: For each band, the templates' sorted signatures and their places in `ids`.
    signatures: list[tuple[np.ndarray, np.ndarray]]
    #: All shingles of the templates, and how many of them a match has at least.
    known: np.ndarray
    least: int


def _band(hashes: np.ndarray, band: int) -> np.ndarray:
    """The band's order of the shingles; a window's signature is its least value."""
    return hashes * (mixed(np.array([band], np.uint64), 500)[0] | np.uint64(1))


def _least_held(size: int) -> int:
    return math.ceil(CONTAINMENT * size - 1e-9)


def template_classes(texts: list[str]) -> list[TemplateClass]:
    """Classes of the templates by size: a class's largest has at most 1.25 times the shingles of its smallest."""
    sets = []
    for i, text in enumerate(texts):
        for chunk in word_chunks(pa.array([text], pa.string()), WORD_BYTES):
            n = min(SHINGLE, len(chunk.hashes))
            if n:
                sets.append((n, np.unique(run_hashes(chunk.hashes, chunk.first, n)[0]), i, len(chunk.hashes) - n + 1))
    sets.sort(key=lambda x: (x[0], x[3], x[2]))
    classes: list[list] = []
    for entry in sets:
        if not classes or classes[-1][0][0] != entry[0] or entry[3] > 1.25 * classes[-1][0][3]:
            classes.append([])
        classes[-1].append(entry)
    out = []
    for members in classes:
        step = -(-members[-1][3] // (BLOCKS - 1)) if members[-1][3] > 1 else 1
        window = step * BLOCKS if members[-1][3] > 1 else 1
        least = min(math.ceil(CONTAINMENT * len(m[1])) / (window + len(m[1]) - math.ceil(CONTAINMENT * len(m[1]))) for m in members)
        bands = band_count(least)
        signatures = []
        for b in range(bands):
            own = np.array([_band(m[1], b).min() for m in members], np.uint64)
            order = np.argsort(own, kind="stable")
            signatures.append((own[order], order))
        out.append(TemplateClass(members[0][0], step, bands, [m[2] for m in members], [m[1] for m in members], signatures,
                                 np.unique(np.concatenate([m[1] for m in members])), min(_least_held(len(m[1])) for m in members)))
    return out


@dataclass
class Windows:
    """Where a class's windows of some rows begin, in shingles."""

    kind: TemplateClass
    row: np.ndarray
    begins: np.ndarray
    width: int
    pairs: set[tuple[int, int]]


def scan_words(words: np.ndarray, first: np.ndarray, kinds: list[TemplateClass]) -> list[tuple[int, int, int, int, float, int]]:
    """(row, template, first word, words, containment, shingles held) of every window that holds a template; all classes have one n."""
    hashes, at = run_hashes(words, first, kinds[0].n)
    if not len(hashes):
        return []
    known = np.concatenate([k.known for k in kinds])
    marks = np.zeros(_MARKS, bool)
    marks[(known % np.uint64(_MARKS)).astype(np.int64)] = True
    spots = np.flatnonzero(marks[(hashes % np.uint64(_MARKS)).astype(np.int64)])
    spots = spots[np.isin(hashes[spots], known)]
    owner, out = np.searchsorted(at, spots, "right") - 1, []
    for kind in kinds if len(spots) else ():
        held = np.bincount(owner[np.isin(hashes[spots], kind.known)], minlength=len(at) - 1)
        rows = np.flatnonzero(held >= kind.least)
        if len(rows):
            sizes = np.diff(at)[rows]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            picked = np.arange(ends[-1]) + np.repeat(at[rows] - ends[:-1], sizes)
            out += [(int(rows[m[0]]), *m[1:]) for m in _scanned(hashes[picked], ends, kind)]
    return out


def _scanned(hashes: np.ndarray, at: np.ndarray, kind: TemplateClass) -> list[tuple[int, int, int, int, float, int]]:
    sizes = np.diff(at)
    blocks = -(-sizes // kind.step)
    row = np.repeat(np.arange(len(sizes)), blocks)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    w = Windows(kind, row, at[:-1][row] + inside * kind.step, BLOCKS if max(map(len, kind.sets)) > 1 else 1, set())
    for band in range(kind.bands):
        ordered = _band(hashes, band)
        least = np.minimum.reduceat(ordered, w.begins) if kind.step > 1 else ordered
        window = least.copy()
        for shift in range(1, min(w.width, len(least))):
            held = np.where(w.row[shift:] == w.row[:-shift], least[shift:], window[:-shift])
            np.minimum(window[:-shift], held, out=window[:-shift])
        wanted, order = kind.signatures[band]
        for found in np.flatnonzero(np.isin(window, wanted)).tolist():
            lo, hi = np.searchsorted(wanted, window[found], "left"), np.searchsorted(wanted, window[found], "right")
            w.pairs.update((found, int(order[k])) for k in range(lo, hi))
    return _verified(w, hashes, at)


def _verified(w: Windows, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
    out = []
    for block, member in sorted(w.pairs):
        row = int(w.row[block])
        begin, end = int(w.begins[block]), int(min(w.begins[block] + w.width * w.kind.step, at[row + 1]))
        wanted = w.kind.sets[member]
        inside = np.isin(hashes[begin:end], wanted)
        held = len(np.unique(hashes[begin:end][inside]))
        if held >= CONTAINMENT * len(wanted) - 1e-9:
            spots = np.flatnonzero(inside)
            out.append((row, w.kind.ids[member], begin - int(at[row]) + int(spots[0]), int(spots[-1] - spots[0]) + w.kind.n, held / len(wanted), held))
    return out


def winners(found: list[tuple[int, int, int, float, int]], names: list[str]) -> list[tuple[int, int, int, float, int]]:
    """(template, first word, words, containment, held) of one text without those that a stronger one of their family outdoes.

    A match is outdone where matches of other licenses of its family with a greater containment, or an equal one of more
    shingles, take half of its words or more. Costs the sum of the matches' words.
    """
    groups: dict[str, list] = {}
    for m in found:
        groups.setdefault(family(names[m[0]]), []).append(m)
    out = []
    for group in groups.values():
        codes = {name: i for i, name in enumerate(sorted({names[m[0]] for m in group}))}
        if len(codes) == 1:
            out += group
            continue
        ranks = {k: i + 1 for i, k in enumerate(sorted({m[3:] for m in group}))}
        base = min(m[1] for m in group)
        rank, code = np.zeros((2, max(m[1] + m[2] for m in group) - base), np.int32)
        for m in sorted(group, key=lambda m: m[3:]):
            rank[m[1] - base:m[1] - base + m[2]], code[m[1] - base:m[1] - base + m[2]] = ranks[m[3:]], codes[names[m[0]]]
        for m in group:
            place = slice(m[1] - base, m[1] - base + m[2])
            if 2 * np.count_nonzero((rank[place] > ranks[m[3:]]) & (code[place] != codes[names[m[0]]])) < m[2]:
                out.append(m)
    return out


_MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("first_word", T.LongType()),
                       T.StructField("words", T.LongType()), T.StructField("containment", T.DoubleType())])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = LICENSE_TEXTS, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with `matches`: (license, template, first_word, words, containment) of each template found in the text.

    A text holds a template if one of the class's windows holds 80 % of its distinct shingles (five words; templates of
    fewer words are one shingle). Of several windows the one with the greatest containment is given, then the first.
    Words are letters, digits and characters outside ASCII, A-Z lower-cased. Null and empty texts have no matches; a
    column named `matches` is replaced; an empty table gives no rows. Of variants of one family at one place the one with
    the greatest containment stays (`winners`). The templates, a list or a table of (license, text), are sent to the tasks.
    """
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.select("license", "text").dropna().orderBy("license", "text").collect()]
    handed = docs.sparkSession.sparkContext.broadcast((template_classes([t for _, t in templates]), [n for n, _ in templates]))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        classes, names = handed.value
        out: list[dict[int, tuple]] = [{} for _ in range(batch.num_rows)]
        for chunk in word_chunks(batch.column(batch.schema.get_field_index(text)), WORD_BYTES):
            matches: dict[int, list] = {}
            for _, kinds in groupby(classes, key=lambda k: k.n):
                for row, *match in scan_words(chunk.hashes, chunk.first, list(kinds)):
                    matches.setdefault(chunk.lo + row, []).append(tuple(match))
            for row, found in matches.items():
                for template, begin, words, share, _ in winners(found, names):
                    before = out[row].get(template)
                    if before is None or (share, -begin) > (before[2], -before[0]):
                        out[row][template] = (begin, words, share)
        rows = [[{"license": names[t], "template": t, "first_word": m[0], "words": m[1], "containment": m[2]} for t, m in sorted(found.items())]
                for found in out]
        kind = pa.struct([("license", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())])
        return [pa.array(rows, pa.list_(kind))]

    return with_arrow_columns(docs, [("matches", T.ArrayType(_MATCH))], make, drop)
