"""License notices in texts with built-in functions only (operator 1).

A text's words are cut into overlapping windows of several sizes, derived from
the templates, so that every notice and license text has windows of at most
twice its own length around it. Of each window the
5-word shingles that occur in any template count; other shingles cannot add to a
template's containment, so windows without such shingles are not built. MinHash
bands of one minimum each retrieve templates: a whole notice of five words is at
least a quarter of the shingles of its smallest window, a longer one more, and
misses all 64 bands with a probability of 1e-8 at most. A retrieved template
matches when the window holds at least three quarters of its shingles, counted
exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.secrets import constant, let

SHINGLE, BANDS, PERCENT = 5, 64, 75
#: Words from one window to the next in the smallest windows, which hold twice as many.
LEAST_STEP = 4
#: Shingles of the templates that are literals of one expression; more templates make more of them.
MOST_SHINGLES = 50_000
WORD_GAP = "[^a-z0-9]+"

#: What several licenses say alike.
_PERMITTED = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Notices, opening paragraphs and whole short texts of public licenses. A notice that differs from another
#: version's in its last word has three shingles at most, so that PERCENT parts the two.
TEMPLATES = {
    "AGPL-3.0": "GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-header": f"{_PERMITTED} {_SOURCE}",
    "BSD-2-Clause-text": f"{_PERMITTED} 1. {_SOURCE} 2. {_BINARY} {_BSD_AS_IS}",
    "BSD-3-Clause-text": f"{_PERMITTED} 1. {_SOURCE} 2. {_BINARY} 3. {_NAMES} {_BSD_AS_IS}",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "the GNU General Public License, version 2.",
    "GPL-3.0": "the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Released under the ISC License.",
    "ISC-header": _ISC_GRANT,
    "ISC-text": f"{_ISC_GRANT} {_ISC_AS_IS}",
    "LGPL-2.1": "Lesser General Public License, version 2.1.",
    "LGPL-3.0": "GNU Lesser General Public License, version 3.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-header": _MIT_GRANT,
    "MIT-text": f"{_MIT_GRANT} {_MIT_AS_IS}",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-header": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def split_words(text: str) -> list[str]:
    """words() of a string."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(WORD_GAP, low) if w]


def windows_of(texts: dict[str, str]) -> list[tuple[int, int]]:
    """Words of a window and words from one to the next, doubling until the longest of the texts lies in one wherever it begins."""
    longest, step, out = max((len(split_words(t)) for t in texts.values()), default=0), LEAST_STEP, []
    while not out or step // 2 + 1 < longest:
        out.append((2 * step, step))
        step *= 2
    return out


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; null and empty texts have none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), WORD_GAP), lambda w: w != "")


def _shingle(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))


def _starts(w: Column) -> Column:
    """0 to the place of the last full shingle; empty with fewer words."""
    return F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))


def band_keys(shingles: Column) -> Column:
    """A key for each band of a non-empty set of shingle hashes."""

    def key(band: int) -> Column:
        return F.xxhash64(F.lit(band), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(1000 + band)))))

    return F.array(*map(key, range(BANDS)))


class Templates:
    """Names, shingle hashes and band keys of the templates; a small stated table, held by the driver.

    A text of fewer words than a shingle can't be looked for: ValueError.
    """

    def __init__(self, spark: SparkSession, texts: dict[str, str]):
        short = sorted(n for n, t in texts.items() if len(split_words(t)) < SHINGLE)
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
        rows = spark.createDataFrame(list(texts.items()), "name string, text string").select("name", words(F.col("text")).alias("w"))
        rows = rows.select("name", F.array_distinct(F.transform(_starts(F.col("w")), lambda i: _shingle(F.col("w"), i))).alias("shingles"))
        self.windows = windows_of(texts)
        #: Blocks of MOST_SHINGLES shingles at most, but for a longer template.
        self.blocks: list[list] = []
        held = MOST_SHINGLES
        for row in rows.select("name", "shingles", band_keys(F.col("shingles")).alias("keys")).orderBy("name").collect():
            if held + len(row["shingles"]) > MOST_SHINGLES:
                self.blocks.append([])
                held = 0
            self.blocks[-1].append(row)
            held += len(row["shingles"])

    @staticmethod
    def vocabulary(block: list) -> list[int]:
        return sorted({h for r in block for h in r["shingles"]})

    @staticmethod
    def column(block: list) -> Column:
        longs = lambda xs: constant(xs, "bigint")
        return F.array(*(F.struct(F.lit(r["name"]).alias("name"), longs(r["shingles"]).alias("shingles"), longs(r["keys"]).alias("keys")) for r in block))


def _windows(hits: Column, size: int, step: int) -> Column:
    """Sets of shingle hashes of the windows of `size` words every `step` words that hold hits (at, h) in order of place.

    The first hit of each stretch of `step` words makes the windows that start
    there and one step before; a window's hits stand at most `size` places
    around it, so the work is linear in the hits.
    """
    block = lambda x: F.floor(x["at"] / step).cast("int")
    new = F.filter(F.transform(hits, lambda x, i: F.struct(block(x).alias("k"), i.alias("i"), ((i == 0) | (block(F.get(hits, i - 1)) != block(x))).alias("new"))), lambda x: x["new"])

    def held(k: Column, i: Column) -> Column:
        near = F.slice(hits, F.greatest(F.lit(1), i + 1 - size), F.lit(2 * size + 1))
        return F.array_distinct(F.transform(F.filter(near, lambda x: (x["at"] >= k * step) & (x["at"] + SHINGLE <= k * step + size)), lambda x: x["h"]))

    return F.filter(F.flatten(F.transform(new, lambda x: F.array(held(x["k"], x["i"]), held(x["k"] - 1, x["i"])))), lambda s: F.size(s) > 0)


def find_licenses(docs: DataFrame, templates: Templates) -> DataFrame:
    """doc_id and licenses, the sorted names of matching templates, for each row of `docs` (doc_id, text).

    Null and empty texts, and texts of fewer words than a shingle, have none.
    Every row gives a row, repeated ones too; other columns are not read; an
    empty table gives an empty one.
    """
    none = F.array().cast("array<string>")
    if not templates.blocks:
        return docs.select("doc_id", none.alias("licenses"))

    def hits(block: list) -> Column:
        vocabulary = templates.vocabulary(block)

        def of(w: Column) -> Column:
            known = F.filter(_starts(w), lambda i: _shingle(w, i).isin(vocabulary))
            return F.transform(known, lambda i: F.struct(i.alias("at"), _shingle(w, i).alias("h")))

        return let(words(F.col("text")), of)

    def matches(s: Column, block: list) -> Column:
        near = let(band_keys(s), lambda keys: F.filter(templates.column(block), lambda t: F.arrays_overlap(t["keys"], keys)))
        sure = F.filter(near, lambda t: F.size(F.array_intersect(t["shingles"], s)) * 100 >= PERCENT * F.size(t["shingles"]))
        return F.transform(sure, lambda t: t["name"])

    def names(at: Column, block: list) -> Column:
        windows = lambda h: F.array_distinct(F.concat(*(_windows(h, *w) for w in templates.windows)))
        return F.when(F.size(at) > 0, let(at, lambda h: let(windows(h), lambda ws: F.flatten(F.transform(ws, lambda s: matches(s, block)))))).otherwise(none)

    found = docs.select("doc_id", *(hits(b).alias(f"hits_{k}") for k, b in enumerate(templates.blocks)))
    return found.select("doc_id", F.array_sort(F.array_distinct(F.concat(*(names(F.col(f"hits_{k}"), b) for k, b in enumerate(templates.blocks))))).alias("licenses"))
