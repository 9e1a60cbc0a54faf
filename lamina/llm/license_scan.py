"""Licence notices found by the overlap of word bigrams with templates.

A unit of text is a line, a paragraph of several lines, or the whole text. Units and templates are normalised to lower
case words of letters and digits; their similarity is the Dice coefficient of the multisets of word bigrams,
2 |A and B| / (|A| + |B|). As the smaller of two sizes bounds the overlap, a unit of a bigrams can only reach t with
templates of t a / (2 - t) to (2 - t) a / t bigrams: units outside the sizes of all templates are not even split
into bigrams.

Notices that don't stand alone in a unit are found by windows over the words of the whole text. A window has at least
as many bigrams as its template, so that words in the place of the template's count against it (version 3 is not version
2.0), and at most (2 - t) / t times as many. Only the places of template bigrams are looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.util import fresh, held, lean, table

LEAST_DICE = 0.8
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Notices by which documents commonly name their licence, and whole texts of short licences (fixed values).
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-2-clause-text": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-3-clause-text": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
_WORD = re.compile(r"[^\W_]+").findall
FOUND = T.ArrayType(
    T.StructType([T.StructField("license", T.StringType()), T.StructField("common", T.LongType()), T.StructField("sizes", T.LongType()), T.StructField("unit", T.StringType())])
)


def bigrams(text: str) -> Counter:
    """The multiset of word bigrams; a text of one word has none."""
    words = _WORD(text.lower())
    return Counter(zip(words, words[1:], strict=False))


def units(text: str) -> list[str]:
    """Lines, paragraphs of several lines and the whole text, each once."""
    out = dict.fromkeys(text.split("\n"))
    if len(out) > 1:
        out |= dict.fromkeys(p for p in re.split(r"\n[ \t]*\n", text) if "\n" in p)
        out[text] = None
    return list(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = round(least * 100)
        self.templates = [(name, grams, grams.total()) for name, text in sorted(templates.items()) if (grams := bigrams(text))]
        sizes = [n for _, _, n in self.templates]
        #: Fewest and most words of a unit that can reach the least similarity with any template.
        self.fewest = min(sizes, default=0) * self.least / (200 - self.least) + 1
        self.most = max(sizes, default=-1) * (200 - self.least) / self.least + 1
        self.grams = frozenset(g for _, template, _ in self.templates for g in template)

    def scan(self, text: str | None) -> list[tuple[str, int, int, str]]:
        """(licence, 2 * common bigrams, sum of sizes, unit) of the best unit for every licence that is found; a unit is
        evidence for its most similar template alone, the first by name of equals. A licence without such a unit has its
        best window instead, if it has one."""
        best: dict[str, tuple[int, int, str]] = {}
        text = text or ""
        every = _WORD(text.lower())
        for unit in units(text):
            if len(unit) < 2 * self.fewest - 1:
                continue
            words = every if unit is text else _WORD(unit.lower())
            if not self.fewest <= len(words) <= self.most:
                continue
            grams, n = Counter(zip(words, words[1:], strict=False)), len(words) - 1
            name, common, sizes = "", 0, 1
            for other, template, size in self.templates:
                if 200 * min(n, size) < self.least * (n + size):
                    continue
                both = 2 * sum(min(c, grams[g]) for g, c in template.items() if g in grams)
                if both * sizes > common * (n + size):
                    name, common, sizes = other, both, n + size
            if name and 100 * common >= self.least * sizes and (name not in best or common * best[name][1] > best[name][0] * sizes):
                best[name] = (common, sizes, unit)
        found = {name: w for name, *w in self.windows(every) if name not in best}
        if found:
            place = _places(text)
            best |= {name: (common, sizes, text[place[begin][0] : place[end - 1][1]]) for name, (common, sizes, begin, end) in found.items()}
        return [(name, *found) for name, found in sorted(best.items())]

    def windows(self, words: list[str]) -> list[tuple[str, int, int, int, int]]:
        """(licence, 2 * common bigrams, sum of sizes, first word, last word + 1) of the best window for every licence
        that is found. Windows are taken from the most similar on, the longer of equals first; one is evidence only if
        less than half of its words are in windows taken before."""
        hits = [(k, g) for k, g in enumerate(zip(words, words[1:], strict=False)) if g in self.grams]
        near = []
        for name, template, size in self.templates:
            # Fewest common bigrams and most bigrams of a window that is similar enough.
            need, longest = max(-(-self.least * size // 100), 1), (200 - self.least) * size // self.least
            if len(hits) < need or len(words) <= size:
                continue
            own = [h for h in hits if h[1] in template]
            at = [k for k, _ in own]
            # The best window starts with a bigram of the template, or is as long as the template and ends with the text.
            for begin in sorted({min(k, len(words) - 1 - size) for k in at}):
                a = bisect_left(at, begin)
                if a + need > len(at) or at[a + need - 1] >= begin + longest:
                    continue
                met, common, top = Counter(), 0, (0, 1)
                for x in range(a, len(own)):
                    k, g = own[x]
                    n = max(size, k - begin + 1)
                    if n > longest:
                        break
                    met[g] += 1
                    common += met[g] <= template[g]
                    if 2 * common * top[1] > top[0] * (n + size):
                        top = (2 * common, n + size)
                if 100 * top[0] >= self.least * top[1]:
                    near.append((-top[0] / top[1], -top[1], name, begin, begin + top[1] - size + 1, top))
        taken, best = bytearray(len(words) if near else 0), {}
        for _, _, name, begin, end, top in sorted(near):
            if 2 * taken.count(1, begin, end) < end - begin:
                taken[begin:end] = b"\1" * (end - begin)
                best.setdefault(name, (*top, begin, end))
        return [(name, *found) for name, found in best.items()]


def _places(text: str) -> list[tuple[int, int]]:
    """Begin and end in text of each word of its lower case, which may be longer than text."""
    low = text.lower()
    at = range(len(text) + 1) if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(at[m.start()], at[m.end() - 1] + 1) for m in re.finditer(r"[^\W_]+", low)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE, into: str = "licenses") -> DataFrame:
    """docs with an array of (license, common, sizes, unit), one for every template that is the best match of some unit or
    window of the text, with a Dice coefficient common / sizes of at least ``least``, by name; a column named like into
    is replaced, all others pass through.

    The unit is the best match, the first of equals; the best window stands for it where no unit matches. Null or empty
    text has none, like a text of one word. Templates of fewer than two words match nothing. Very long texts are scanned
    whole, one at a time. Repeated rows get equal arrays; an empty table gives an empty one. Nothing is shuffled.
    """

    @F.arrow_udf(FOUND)
    @lean
    def scan(texts: pa.Array) -> pa.Array:
        scanner = held(("licenses", tuple(sorted(templates.items())), least), lambda: Scanner(templates, least))
        rows = [[dict(zip(("license", "common", "sizes", "unit"), x, strict=True)) for x in scanner.scan(t.as_py())] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("license", pa.string()), ("common", pa.int64()), ("sizes", pa.int64()), ("unit", pa.string())])))

    return docs.withColumn(into, scan(F.col("text")))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """One row for each licence of a document, or one of nulls for a document without, in the cases of scan_licenses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    (found,) = fresh("found", taken=docs.columns)
    rows = scan_licenses(docs, into=found).select("doc_id", F.explode_outer(found).alias("x"))
    return rows.select("doc_id", "x.license", "x.common", "x.sizes", F.expr("(1000000 * x.common) div x.sizes").alias("dice_ppm"), F.sha2("x.unit", 256).alias("unit_sha256"))
