"""License scans: MinHash of overlapping text windows finds templates, exact shingle containment verifies them.

A template of n shingles is looked for in windows of the least width w = 1, 2,
4, ... whose stride (a quarter of it) still lets some window hold a whole copy.
A window that contains 75 % of the template has at least a Jaccard similarity
that follows from n and w, and every permutation gives a band of one value; so
many bands are compared that a containing window is missed with a chance of at
most ``MISS``. What the bands retrieve is then counted shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclabel.llm.common import flat_bytes, hashed_words, mix, row_groups, word_table
from doclabel.session import ship_package

SHINGLE, PERCENT, MISS = 5, 75, 1e-6
GROUP_BYTES, BLOCK_BYTES = 1 << 20, 1 << 20
_INSIDE, _LOW = word_table()
_POWERS = [np.uint64(pow(0x9FB21C651E98DF25, i, 1 << 64)) for i in range(SHINGLE)]

# Public license statements, notices and body texts. ASCII without apostrophes (a space in their place gives the same words).
# GNU notices differ in few words: license and version are told apart by a template each.
_GNU = {"agpl": "the GNU Affero General Public License", "gpl": "of the GNU General Public License", "lgpl": "the GNU Lesser General Public License", "lgpl-2": "the GNU Library General Public License"}
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# Creative Commons: deed and name.
_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_SPDX = (
    "0BSD AGPL-3.0 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 "
    "OFL-1.1 Unlicense WTFPL Zlib").split()
# One-line variants: what follows "under".
_UNDER = {
    "agpl": "the GNU Affero General Public License", "apache-2.0-name": "the Apache 2.0 License", "apache-2.0-plain": "the Apache License 2.0", "artistic": "the Artistic License 2.0",
    "bsd": "a BSD-style license", "bsd-2": "the BSD 2-Clause License", "bsd-3": "the BSD 3-Clause License", "bsd-new": "the new BSD License", "bsd-simplified": "the simplified BSD License",
    "boost-1.0": "the Boost Software License", "cc0": "the Creative Commons CC0", "cddl": "the Common Development and Distribution License", "epl": "the Eclipse Public License",
    "eupl": "the European Union Public Licence", "gfdl": "the GNU Free Documentation License", "gpl-2-v": "the GNU General Public License v2",
    "gpl-2-gpl": "the GNU GPL version 2", "gpl-3-v": "the GNU General Public License v3", "gpl-3-gpl": "the GNU GPL version 3",
    "lgpl": "the GNU Lesser General Public License", "lgpl-2": "the GNU Library General Public License", "mpl": "the Mozilla Public License", "ofl-1.1": "the SIL Open Font License", "python-2": "the Python Software Foundation License",
}

TEMPLATES = {
    "all-rights-reserved": "All rights reserved",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    # Notices and body texts.
    "agpl-3-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "apache-2.0-text": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "artistic-2.0-text": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",
    "boost-1.0-notice": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": _BSD_WARRANTY,
    "cc0-deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    "cc0-waiver": "has waived all copyright and related or neighboring rights to",
    "cddl-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "gfdl-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "gnu-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-2-text": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-3-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-2.1-text": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "lgpl-3-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
    "mpl-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "unlicense-dedication": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "wtfpl-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "zlib-notice": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    # One-line variants.
    "gpl-2": "the GNU General Public License, version 2",
    "gpl-3-version": "the GNU General Public License, version 3",
    "isc": "under the ISC License",
    "mit-available": "Available under the MIT License",
    "mit-distributed": "Distributed under the MIT License",
    "mit-header": "MIT License Copyright (c)",
    "mit-licensed": "Licensed under the MIT License",
    "mit-name": "The MIT License (MIT)",
    "mit-published": "Published under the MIT License",
    "mit-terms": "the terms of the MIT License",
    "public-domain": "released into the public domain",
    "unlicense": "under the Unlicense",
    "zlib": "under the zlib License",
}
TEMPLATES |= {f"{name}-notice": f"{what} as published by the Free Software Foundation" for name, what in _GNU.items()}
TEMPLATES |= {f"gnu-{version}-or-later": f"either version {version} of the License, or (at your option)" for version in ("2", "2.1", "3")}
TEMPLATES |= {f"{name}-under": f"under {what}" for name, what in _UNDER.items()}
TEMPLATES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in _SPDX}
for _deed, _name in _CC.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        _key = f"cc-{_deed}-{_version}"
        TEMPLATES.setdefault(_key, f"This work is licensed under a Creative Commons {_name} {_version} {_scope} License")
        TEMPLATES[f"{_key}-the"] = f"under the Creative Commons {_name} {_version} {_scope} License"
        TEMPLATES[f"{_key}-url"] = f"creativecommons.org/licenses/{_deed}/{_version}"
        TEMPLATES[f"{_key}-spdx"] = f"SPDX-License-Identifier: CC-{_deed.upper()}-{_version}"
        TEMPLATES[f"{_key}-short"] = f"under a CC {_deed.upper()} {_version} license"
        if _key != "cc-by-nc-4.0":
            TEMPLATES[f"{_key}-licensed"] = f"Licensed under CC {_deed.upper()} {_version}"
TEMPLATES["cc-by-nc-4.0-work"] = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"
TEMPLATES["cc0-url"] = "creativecommons.org/publicdomain/zero/1.0"


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def window_of(n: int) -> tuple[int, int]:
    """(width, stride) in shingles of the windows for a template of ``n`` shingles."""
    width = 1
    while n > width - max(1, width // 4) + 1:
        width *= 2
    return width, max(1, width // 4)


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def bands_for(n: int, width: int, percent: int, miss: float) -> int:
    """Bands of one value that leave a chance of ``miss`` to overlook a window that contains ``percent`` of the template."""
    shared = needed(n, percent)
    jaccard = shared / (width + n - shared)
    return 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    n = max(len(words) - size + 1, 0)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += words[i : i + n] * _POWERS[i]
    return mix(out)


def _permuted(grams: np.ndarray, number: int) -> np.ndarray:
    return mix(grams ^ mix(np.array([number + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


@dataclass
class Template:
    name: str
    size: int  # words of a shingle
    grams: np.ndarray  # its distinct shingles, sorted
    words: int


class Index:
    """Templates by shingle size and window width, and for each band a table from least values to templates."""

    def __init__(self, names: list[str | None], texts: pa.Array, percent: int = PERCENT, miss: float = MISS):
        data, offsets = flat_bytes(texts)
        words, bounds = hashed_words(data, offsets, _INSIDE, _LOW)
        self.percent = percent
        self.groups: dict[tuple[int, int, int], list[Template]] = {}
        for name, a, b in zip(names, bounds[:-1], bounds[1:]):
            if name is None or a == b:
                continue
            size = min(SHINGLE, int(b - a))
            grams = np.unique(_grams(words[a:b], size))
            # The words of a template's shingles span its words, also where one repeats.
            width, stride = window_of(int(b - a) - size + 1)
            self.groups.setdefault((size, width, stride), []).append(Template(name, size, grams, int(b - a)))
        self.tables = {}
        for key, templates in self.groups.items():
            n_bands = max(bands_for(len(t.grams), key[1], percent, miss) for t in templates)
            bands = []
            for number in range(n_bands):
                least = np.array([_permuted(t.grams, number).min() for t in templates], np.uint64)
                order = np.argsort(least)
                flags = np.zeros(1 << 16, bool)
                flags[(least & np.uint64(0xFFFF)).astype(np.int64)] = True
                bands.append((flags, least[order], order))
            self.tables[key] = bands

    def candidates(self, grams: np.ndarray, key: tuple[int, int, int]) -> set[tuple[int, int]]:
        """(window start, template) pairs that share a band; windows start at multiples of the stride and may be cut by the end."""
        _, width, stride = key
        starts = np.arange(0, len(grams), stride)
        padded = np.concatenate([grams, np.zeros(width, np.uint64)])
        found: set[tuple[int, int]] = set()
        for number, (flags, least, order) in enumerate(self.tables[key]):
            values = _permuted(padded, number)
            values[len(grams) :] = np.uint64(2**64 - 1)
            reach = 1
            while reach < width:
                values = np.minimum(values[:-reach], values[reach:])
                reach *= 2
            values = values[starts]
            hits = np.flatnonzero(flags[(values & np.uint64(0xFFFF)).astype(np.int64)])
            if not len(hits):
                continue
            low, high = np.searchsorted(least, values[hits], "left"), np.searchsorted(least, values[hits], "right")
            for h, a, b in zip(hits[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                found.update((h * stride, int(order[k])) for k in range(a, b))
        return found

    def scan(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(row, license, first word, words, containment) of windows that contain a template; words cut at the row's end."""
        out = []
        for key, templates in self.groups.items():
            size, width, _ = key
            grams = _grams(words, size)
            for row in self._rows(grams, bounds, size, key):
                a, b = int(bounds[row]), int(bounds[row + 1])
                mine = grams[a : b - size + 1]
                for start, k in sorted(self.candidates(mine, key)):
                    template = templates[k]
                    shared = np.count_nonzero(np.isin(template.grams, mine[start : start + width]))
                    if 100 * shared >= self.percent * len(template.grams):
                        out.append((row, template.name, start, min(width + size - 1, b - a - start), shared / len(template.grams)))
        return out

    def _rows(self, grams, bounds, size, key) -> Iterator[int]:
        """Rows in which some band's least template value occurs at all: no other row can collide."""
        pivots = np.unique(np.concatenate([t.grams for t in self.groups[key]]))
        flags = np.zeros(1 << 16, bool)
        flags[(pivots & np.uint64(0xFFFF)).astype(np.int64)] = True
        hits = np.flatnonzero(flags[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        hits = hits[np.isin(grams[hits], pivots)]
        rows = np.searchsorted(bounds, hits, side="right") - 1
        rows = rows[hits + size <= bounds[rows + 1]]
        yield from np.unique(rows).tolist()


def scan_licenses(docs: DataFrame, templates: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """License templates in whole texts: doc_id, n_words, matches (license, start, words, containment).

    ``templates`` has (license, text). Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased; shingles have five words, those of a
    shorter template all of its words. A match is a window that contains at least
    ``percent`` of a template's shingles; neighbouring windows over one copy each
    count, so ``matches`` tells where a license is, not how often.

    Null or empty texts have no words. Rows with null or repeated ids are read
    one by one; templates without name or words are skipped, repeated ones match
    again. Empty tables: no rows, or no matches. Templates visit the driver in
    blocks of about ``block_bytes``; documents are not shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = templates.select("license", F.coalesce("text", F.lit("")).alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = "doc_id bigint, text string, n_words bigint, matches array<struct<license: string, start: int, words: int, containment: double>>"
    match = pa.struct([("license", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("containment", pa.float64())])
    out = docs.select(F.col("doc_id").cast("bigint"), "text", F.lit(0).cast("bigint"), F.array().cast("array<struct<license: string, start: int, words: int, containment: double>>"))
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("license", "text"), F.lit(blocks)) == block).toArrow()
        index = spark.sparkContext.broadcast(Index(part["license"].to_pylist(), part["text"], percent))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = flat_bytes(batch.column(1))
                counts, matches = np.zeros(batch.num_rows, np.int64), batch.column(3).to_pylist()
                for a, b in row_groups(offsets, GROUP_BYTES):
                    low = offsets[a]
                    words, bounds = hashed_words(data[low : offsets[b]], offsets[a : b + 1] - low, _INSIDE, _LOW)
                    counts[a:b] = np.diff(bounds)
                    for row, name, start, n, share in index.value.scan(words, bounds):
                        matches[a + row].append({"license": name, "start": start, "words": n, "containment": share})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(matches, pa.list_(match))], ["doc_id", "text", "n_words", "matches"])

        out = out.mapInArrow(scan, schema)
    return out.drop("text")
