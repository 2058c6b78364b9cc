"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams; DataFrame functions only.

Units are the whole text, its paragraphs and lines, and two or three of them in a row. The coefficient is that of sets:
2 * shared / (n + m), all counts of distinct bigrams. A unit can reach t with a template of m only if n is within
m * t / (2 - t) and m * (2 - t) / t, and it then shares m * t / (2 - t) bigrams at least. So of each template some words
are enough that every such unit holds one of them; texts without any such word are never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and short public licence texts by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
THRESHOLD_PERCENT = 80
#: Words that say little of a text's being a licence; others are looked for first.
PLAIN = frozenset("a an and any are as be by can found for from in is it may no not of on or other such that the this to under use used with without work you".split())
#: Lines or paragraphs in a row that are a unit, at most.
RUNS = 3


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_bigrams(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, tuple[str, ...]]]:
    """(licence, its distinct word bigrams) for each template."""
    import re

    out = []
    for name, texts in templates.items():
        for text in texts:
            w = re.findall(r"[a-z0-9]+", text.lower())
            out.append((name, tuple(sorted({f"{a} {b}" for a, b in zip(w, w[1:])}))))
    return out


def _bounds(m: int, percent: int) -> tuple[int, int]:
    """Sizes n with which 2 * min(n, m) / (n + m) reaches the threshold."""
    low = next(n for n in range(1, m + 1) if 200 * n >= percent * (n + m))
    return low, m * (200 - percent) // percent


def key_words(known: list[tuple[str, tuple[str, ...]]], percent: int) -> list[str]:
    """Words of which every unit that reaches a template holds one: of each template, long words first, until fewer
    bigrams are without them than a unit must share."""
    out = set()
    for _, bigrams in known:
        least = -(-percent * len(bigrams) // (200 - percent))
        words = sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w in PLAIN, -len(w), w))
        own = set()
        while sum(not own & set(b.split()) for b in bigrams) >= least:
            own.add(words[len(own)])
        out |= own
    return sorted(out)


def scan_licenses(docs: DataFrame, percent: int = THRESHOLD_PERCENT, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, licenses, best_license, best_dice), one row for each row of docs.

    Units are the whole text, its paragraphs (between empty lines) and its lines, and two or three of either in a row.
    Normalised: A-Z lower-cased, words are runs of a-z and 0-9. Coefficient: 2 * shared / (n + m) over the distinct
    bigrams of the unit (n), of the template (m) and of both. licenses: identifiers of templates that some unit reaches
    with percent / 100, sorted; best_license: the one of the highest coefficient, of equal ones the first by name;
    best_dice: that coefficient; null where there is none. Null and empty texts have no licence. Repeated rows are scanned
    each on its own; other columns are ignored; an empty table gives no rows. Rows are scanned where they are, without a
    shuffle. A notice within a line of other words is found only if the whole line reaches the threshold.
    """
    known = template_bigrams(templates)
    bounds = [_bounds(len(b), percent) for _, b in known]
    low = min(a for a, _ in bounds)
    every = sorted({x for _, bs in known for x in bs})
    text = _ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    some = text.rlike(f"(?<![a-z0-9])(?:{'|'.join(key_words(known, percent))})(?![a-z0-9])")
    normal = F.when(some, F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9\n]+", " "), " ?\n ?", "\n"))).otherwise(F.lit(""))
    bind = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  x is worked out once
    among = lambda some: lambda x: x.isin(*some)

    def scored(bg: Column) -> Column:
        def of(n: Column, hits: Column) -> Column:
            found = []
            for (name, bigrams), (least, most) in zip(known, bounds, strict=True):
                shared = F.size(F.filter(hits, among(bigrams)))
                d = F.struct((-2.0 * shared / (n + len(bigrams))).alias("d"), F.lit(name).alias("l"))
                found.append(F.when(n.between(least, most) & (F.size(hits) >= least) & (200 * shared >= percent * (n + len(bigrams))), d))
            return F.filter(F.array(*found), lambda x: x.isNotNull())

        return F.flatten(F.transform(F.array(F.filter(bg, among(every))), lambda hits: of(F.size(bg), hits)))

    def bigrams(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    def joined(parts: Column, k: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(parts) - (k - 1)), lambda i: F.array_join(F.slice(parts, i, k), " "))
        return F.when(F.size(parts) >= k, run).otherwise(F.array().cast("array<string>"))

    def rows(parts: Column) -> Column:
        """The parts, and two to RUNS of them in a row."""
        more = [joined(parts, k) for k in range(2, RUNS + 1)]
        return F.concat(parts, *more)

    def hits(t: Column) -> Column:
        units = F.concat(rows(F.split(t, "\n+")), rows(F.split(t, "\n\n+")), F.array(t))
        # a unit of several lines is brought to one line
        units = F.array_distinct(F.transform(units, lambda u: F.translate(F.regexp_replace(u, "\n+", "\n"), "\n", " ")))
        units = F.filter(units, lambda u: F.length(u) - F.length(F.translate(u, " ", "")) >= low)
        return F.flatten(F.transform(F.transform(units, lambda u: bigrams(F.split(u, " "))), scored))

    out = docs.select(F.col("doc_id"), F.when(some, F.sort_array(bind(normal, hits))).otherwise(F.array().cast("array<struct<d:double,l:string>>")).alias("hits"))
    first = F.try_element_at("hits", F.lit(1))
    return out.select("doc_id", F.array_sort(F.array_distinct(F.col("hits.l"))).alias("licenses"), first["l"].alias("best_license"), (-first["d"]).alias("best_dice"))
