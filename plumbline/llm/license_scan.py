"""License scans: word-bigram Dice coefficients against licence templates, pruned by size (native).

A unit of a document is compared with a template as sets of word bigrams: the unit is normalised (lower
case, letters and digits only) and cut into words. Units are

- ``text``: the document as a whole,
- ``line``: every line of a document of several,
- ``window``: for each template, as many words as it has, from any place where one of its bigrams
  stands. So a licence wrapped over lines, or inside a longer line, is a unit whatever surrounds it.

With sizes a and b the Dice coefficient is at most 2 * min(a, b) / (a + b), so a template whose
size makes that bound too low is not compared; a unit outside every template's bounds is not
compared at all. A match must also share a bigram among those of the template that it cannot all
miss; texts and lines without any of those words are skipped. Windows are looked at only for
templates of which the whole document has enough bigrams. All three lose nothing.

Defined results: null and empty texts and units of fewer than two words have no bigrams and match
nothing; among equal scores the first template in order wins; repeated rows repeat; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, id_and_text

PERCENT = 80
_CONDITIONS = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_NO_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Public licence texts and notices (licence, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"{_CONDITIONS} {_AS_IS}"),
    ("MIT", _CONDITIONS),
    ("MIT", _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", _CLAUSES),
    ("BSD-2-Clause", f"{_CLAUSES} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_CLAUSES} {_NO_ENDORSEMENT}"),
    ("BSD-3-Clause", f"{_CLAUSES} {_NO_ENDORSEMENT} {_DISCLAIMER}"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text, normalised as ``bigrams`` does."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))  # noqa: B905


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The distinct word bigrams of an array of words."""
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.array_distinct(F.slice(pairs, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)))


def signal_words(percent: int, templates=TEMPLATES) -> list[str]:
    """Words of which every unit that matches some template has at least one.

    At Dice coefficient t a match shares at least t / (2 - t) of a template's bigrams. Words are chosen, longest first, until
    the bigrams without any of them are too few for a match.
    """
    chosen: set[str] = set()
    for _, text in templates:
        pairs = [p.split() for p in template_bigrams(text)]
        free = math.ceil(len(pairs) * percent / (200 - percent)) - 1
        for word in sorted({w for p in pairs for w in p}, key=lambda w: (w not in chosen, -len(w), w)):
            if sum(not chosen & set(p) for p in pairs) <= free:
                break
            chosen.add(word)
    return sorted(chosen)


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _literal(strings: list[str]) -> Column:
    """A foldable array of strings without line breaks."""
    return F.split(F.lit("\n".join(strings)), "\n")


def scan(docs: DataFrame, percent: int = PERCENT, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, unit, license, template, dice, n_bigrams: units that reach the threshold.

    For the text and each line (``unit``: 0, or the line's number from 1) the best template; for each
    template its best window (``unit``: the window's first word, from 0; of equals the first).
    Templates are constants of the plan, so there is no join and nothing is shuffled.
    """
    sets = [template_bigrams(t) for _, t in templates]
    # Words end where letters and digits do, as in the normal form.
    signal = "(?<![a-z0-9])(?:" + "|".join(signal_words(percent, templates)) + ")(?![a-z0-9])"
    rows = id_and_text(docs, id_col, text_col).where(F.regexp_like(F.lower(F.col("text")), F.lit(signal)))
    return _units(rows, percent, templates, sets, signal).unionByName(_windows(rows, percent, templates, sets))


def _units(rows: DataFrame, percent: int, templates, sets: list[list[str]], signal: str) -> DataFrame:
    """Whole texts and lines."""
    low, high = min(map(len, sets)), max(map(len, sets))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("unit"), x.alias("part")))
    units = F.concat(F.array(F.struct(F.lit(0).alias("unit"), text.alias("part"))), F.when(F.size(lines) > 1, lines).otherwise(F.slice(lines, 1, 0)))
    units = F.filter(units, lambda u: F.regexp_like(F.lower(u["part"]), F.lit(signal)))
    each = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.part")
    each = computed(each, "words", normal_words(F.col("part")))
    each = computed(each, "own", bigrams(F.col("words"))).select("doc_id", "unit", "own")
    size = F.size("own")
    can = lambda n: F.least(size, F.lit(n)) * 200 >= (size + n) * percent  # noqa: E731  the bound on the coefficient, in integers
    each = each.where((size > 0) & (can(low) | can(high) | size.between(low, high)))
    scores = []
    for k, ((name, _), pairs) in enumerate(zip(templates, sets, strict=True)):
        common = F.size(F.array_intersect("own", _literal(pairs)))
        dice = F.when(can(len(pairs)), common * 2.0 / (size + len(pairs))).otherwise(0.0)
        scores.append(F.struct(dice.alias("dice"), F.lit(-k).alias("order"), F.lit(name).alias("license")))
    best = computed(each, "best", F.array_max(F.array(*scores))).select("doc_id", "unit", F.size("own").cast("long").alias("n_bigrams"), "best").where(F.col("best.dice") * 100 >= percent)
    return best.select(
        "doc_id", F.when(F.col("unit") == 0, "text").otherwise("line").alias("kind"), F.col("unit").cast("long").alias("unit"), F.col("best.license").alias("license"),
        (-F.col("best.order")).cast("long").alias("template"), F.round("best.dice", 9).alias("dice"), "n_bigrams",
    )


def _windows(rows: DataFrame, percent: int, templates, sets: list[list[str]]) -> DataFrame:
    """For each template the best run of as many words as it has."""
    words = F.col("words")
    each = computed(rows, "words", normal_words(F.coalesce(F.col("text"), F.lit("")))).select("doc_id", "words").where(F.size(words) > 1)
    pairs = F.slice(F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))), F.lit(1), F.size(words) - 1)
    each = computed(each, "pairs", pairs).select("doc_id", "pairs")
    each = computed(each, "some", F.array_intersect("pairs", _literal(sorted({x for s in sets for x in s})))).select("doc_id", "pairs", "some").where(F.size("some") > 0)
    own = []
    for k, ((name, text), found) in enumerate(zip(templates, sets, strict=True)):
        enough = F.size(F.array_intersect("some", _literal(found))) * (200 - percent) >= percent * len(found)
        fields = (F.lit(k).alias("k"), F.lit(name).alias("license"), F.lit(len(template_words(text)) - 1).alias("width"), _literal(found).alias("own"))
        own.append(F.when(enough, F.struct(*fields)))
    each = each.select("doc_id", "pairs", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("t"))
    at = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains(F.col("t.own"), F.get("pairs", i)))
    each = computed(each, "at", at)

    def scored(i: Column) -> Column:
        part = F.slice("pairs", i + 1, F.col("t.width"))
        common, size = F.size(F.array_intersect(part, F.col("t.own"))), F.size(F.array_distinct(part))
        return F.struct((common * 2.0 / (size + F.size("t.own"))).alias("dice"), (-i).alias("place"), size.alias("n"))

    best = computed(each, "best", F.array_max(F.transform("at", scored))).select("doc_id", "t.k", "t.license", "best").where(F.col("best.dice") * 100 >= percent)
    return best.select(
        "doc_id", F.lit("window").alias("kind"), (-F.col("best.place")).cast("long").alias("unit"), "license", F.col("k").cast("long").alias("template"), F.round("best.dice", 9).alias("dice"),
        F.col("best.n").cast("long").alias("n_bigrams"),
    )
