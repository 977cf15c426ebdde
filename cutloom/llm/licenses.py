"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are compared without case or ASCII punctuation; a shingle is five of them in a row. Windows of 4, 8, 16, ... shingles overlap by three quarters, and a template is looked for in the windows of
the least size that any place of it fits into with a tenth to spare. A window that holds
``containment`` of the template's shingles has at least a known similarity to it, and BANDS one-value bands
are enough for such a pair to share one with probability GUARANTEE. Templates are a fixed table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cutloom.llm import _words
from cutloom.llm._tables import documents, picked

SHINGLE = 5
CONTAINMENT = 0.8
GUARANTEE = 0.999
MOST_TEMPLATES = 10_000
U = np.uint64

#: Notices of public licenses, by SPDX identifier. Several texts may stand for one license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

#: Bytes as they are compared: capitals as lower case, other ASCII that is no digit or letter as a space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def shingle_rows(s: _words.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    plain = _words.Slice(s.first, _PLAIN[s.data], s.offsets)
    w = _words.words(plain)
    return _words.shingles(_words.word_hashes(plain, w), w.rows, k)


def window_size(n: int) -> int:
    """The least power of two, 4 at least, whose windows, a quarter of it apart, hold any run of n shingles and a tenth."""
    size = 4
    while size - size // 4 + 1 < math.ceil(1.1 * n):
        size *= 2
    return size


def bands_needed(similarity: float, guarantee: float = GUARANTEE) -> int:
    """One-value bands such that two sets of that similarity share one with the guaranteed probability: 1 - (1 - s)**b >= g."""
    return math.ceil(math.log(1 - guarantee) / math.log(1 - similarity)) if similarity < 1 else 1


@dataclass
class Index:
    """Templates ready for retrieval: their shingles, and for each window size and band the sorted least values and whose they are."""

    names: list[str]
    sets: list[np.ndarray]
    sizes: list[int]
    bands: int
    k: int
    containment: float

    def __post_init__(self):
        factors = np.random.default_rng(4).integers(1, 1 << 63, self.bands, dtype=U)
        self.factors = factors * U(2) + U(1)
        self.by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in sorted(set(self.sizes)):
            own = [t for t, x in enumerate(self.sizes) if x == size]
            lists = []
            for f in self.factors:
                least = np.array([_words.mix_light(self.sets[t] * f).min() for t in own], U)
                order = np.argsort(least, kind="stable")
                lists.append((least[order], np.array(own)[order]))
            self.by_size[size] = lists


def index(templates=TEMPLATES, k=SHINGLE, containment=CONTAINMENT, guarantee=GUARANTEE) -> Index:
    """Templates of no word are left out. A template of fewer than k words is one shingle that only an equal whole text matches."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates are broadcast; there are {len(templates)}")
    names, sets, sizes, least = [], [], [], 1.0
    for name, text in templates:
        for s in _words.slices(pa.array([text])):
            sh, _ = shingle_rows(s, k)
            if len(sh):
                names.append(name)
                sets.append(np.unique(sh))
                sizes.append(window_size(len(sh)))
                held = containment * len(sets[-1])
                least = min(least, held / (sizes[-1] + len(sets[-1]) - held))
    return Index(names, sets, sizes, bands_needed(least, guarantee), k, containment)


def candidates(sh: np.ndarray, found: Index) -> set[tuple[int, int]]:
    """(template, window's first shingle) pairs that share a band, for windows over the shingles of a slice in a row."""
    hits: set[tuple[int, int]] = set()
    longest = max(found.by_size, default=0)
    for band, f in enumerate(found.factors):
        least, size = _words.mix_light(sh * f), 1
        while size < longest:
            reach = min(size, len(least) - 1)
            if reach > 0:
                least = np.concatenate([np.minimum(least[:-reach], least[reach:]), least[len(least) - reach :]]) if reach == size else np.minimum.accumulate(least[::-1])[::-1]
            size *= 2
            if size in found.by_size:
                values, owners = found.by_size[size][band]
                step = size // 4
                at = least[::step]
                low = np.searchsorted(values, at, "left")
                near = np.flatnonzero((low < len(values)) & (values[np.minimum(low, len(values) - 1)] == at))
                for x in near.tolist():
                    t = int(low[x])
                    while t < len(values) and values[t] == at[x]:
                        hits.add((int(owners[t]), x * step))
                        t += 1
    return hits


def place(own: np.ndarray, sh: np.ndarray, containment: float) -> tuple[float, int, int]:
    """Of a run of shingles that holds containment of the template's own (sorted) ones: (share, first, end) of the place where it does so soonest.

    The place goes on behind that by the length that the missing shingles would have, and begins as late as it can without losing one.
    """
    k = np.minimum(np.searchsorted(own, sh), len(own) - 1)
    held = np.flatnonzero(own[k] == sh)
    _, first = np.unique(k[held], return_index=True)
    news = held[np.sort(first)]
    enough = max(1, math.ceil(containment * len(own) - 1e-9))
    reach = int(news[enough - 1]) + math.ceil(1.1 * (len(own) - enough))
    end = int(news[news <= reach][-1]) + 1
    held = held[held < end]
    back = np.unique(k[held][::-1], return_index=True)[1]
    return len(back) / len(own), int(held[len(held) - 1 - back.max()]), end


def matches(s: _words.Slice, found: Index) -> list[dict[int, list[tuple[float, int]]]]:
    """For each row of the slice: template -> (containment, first shingle in the row) of all its places, which don't overlap, in order."""
    sh, first = shingle_rows(s, found.k)
    out: list[dict[int, list[tuple[float, int]]]] = [{} for _ in range(s.rows)]
    if not len(sh) or not found.names:
        return out
    taken: dict[int, int] = {}
    for t, at in sorted(candidates(sh, found)):
        size = found.sizes[t]
        low, high = max(at - size // 4, taken.get(t, 0)), at + size + size // 4
        row = int(np.searchsorted(first, max(at, 0), "right")) - 1
        while row < s.rows and first[row] < at + size:
            last = int(first[row + 1])
            a, b = max(low, int(first[row])), min(high, last)
            while b > a and np.isin(found.sets[t], sh[a:b]).mean() >= found.containment - 1e-9:
                share, start, end = place(found.sets[t], sh[a : min(b + size, last)], found.containment)
                out[row].setdefault(t, []).append((share, a + start - int(first[row])))
                a = taken[t] = a + end
            row += 1
    return out


MATCHES = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("containment", pa.float64()), ("word", pa.int32())]))


def _scanned(batches, found: Index):
    for batch in batches:
        for s in _words.slices(batch.column(1)):
            rows = matches(s, found)
            lists = [[{"license": found.names[t], "template": t, "containment": round(c, 6), "word": w} for t, places in sorted(r.items()) for c, w in places] for r in rows]
            names = [sorted({m["license"] for m in row}) for row in lists]
            part = batch.slice(s.first, s.rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(n) for n in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(lists, MATCHES)], ["doc_id", "n_licenses", "licenses", "matches"])


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES, k=SHINGLE, containment=CONTAINMENT, guarantee=GUARANTEE) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted), matches (license, template, containment, first word) of every whole text.

    A template matches where a window and a quarter of it on either side holds ``containment`` of its shingles
    or more; a text has a match for each place of it, and a template's places don't overlap. Null and empty texts have none. One row per input row, repeated ones included; an empty table
    gives an empty table; other columns are ignored. No shuffle; the templates' index is sent to the tasks, at
    most MOST_TEMPLATES of them.
    """
    found = index(templates, k, containment, guarantee)
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scanned(b, found), f"doc_id {kind}, n_licenses long, licenses array<string>, matches array<struct<license:string,template:int,containment:double,word:int>>")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
