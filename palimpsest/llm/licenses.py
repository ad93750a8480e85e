"""Licence notices found by Dice similarity of word bigrams to templates.

A text and a template are normalised (lower case, every run of characters that are neither letters nor digits is one
space) and become sets of word bigrams. The units of a text are its lines; the whole text, if it has several; and for
each template the best window of the template's length in the whole text, wherever its lines break, so that a notice
inside a longer line, or wrapped over lines of a longer file, is found. The Dice coefficient 2|A & B| / (|A| + |B|) can
only reach the threshold t if both sizes are within a factor t / (2 - t), so a line or text is compared only with
templates in those bounds, and most with none; the bounds hold for the distinct bigrams, as words can repeat. A window
can only reach it if the text has t / (2 - t) of the template's bigrams, so most texts have no windows to look at; those
that have are looked at where they start with a bigram of the template. All is done inside a row: no shuffle, and no
row depends on another.

Cases: null and empty texts have no units. Units of one word have no bigram and match nothing. Equal scores go to the
template that comes first by name. Repeated rows are judged one by one; input columns are kept, and those that have a
result's name are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, refuse

# Short notices and full texts of common licences, as published by their authors or as commonly written.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

THRESHOLD = 0.8
UNIT = r"[^\p{L}\p{N}\n]+"


def pairs_of_text(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def templates() -> list[tuple[str, list[str], int]]:
    """(name, distinct bigrams, length in bigrams) of each template."""
    return sorted((name, sorted(set(pairs_of_text(t))), len(pairs_of_text(t))) for name, texts in TEMPLATES.items() for t in texts)


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold with a template of so many."""
    low, high = size * threshold / (2 - threshold), size * (2 - threshold) / threshold
    return -int(-low // 1), int(high)


def pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(words: Column) -> Column:
    return F.array_distinct(pairs(words))


def dice(unit: Column, template: Column) -> Column:
    """Of distinct bigrams."""
    return 2.0 * F.size(F.array_intersect(unit, template)) / (F.size(unit) + F.size(template))


RESULT = ("n_matches", "licenses", "best_license", "best_dice")


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_matches (units), licenses (names, sorted, comma-joined), best_license and best_dice (null if none)."""
    refuse(docs, *RESULT)
    kinds = [(name, grams, length, *bounds(len(grams), threshold)) for name, grams, length in templates()]
    least = min(k[3] for k in kinds)
    fields = ("name", "grams", "length", "low", "high")
    given = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, k, strict=True)]) for k in kinds])
    vocabulary = F.lit(sorted({g for k in kinds for g in k[1]}))
    lines_, pairs_, known_, sets_, whole_, found_, windows_, best_ = fresh(docs, *[f"_{x}" for x in ("lines", "pairs", "known", "sets", "whole", "found", "windows", "best")])

    lines = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), UNIT, " "), "\n", -1)
    read = docs.withColumn(lines_, F.transform(lines, lambda x: F.filter(F.split(x, " "), lambda w: w != "")))
    read = read.withColumn(pairs_, pairs(F.flatten(lines_)))
    # Texts without enough of any template's bigrams have no window to look at.
    read = read.withColumn(known_, F.array_intersect(pairs_, vocabulary))
    # Repeated bigrams make a set smaller than its words, so only the lower bound prunes before the set is known.
    units = F.filter(F.col(lines_), lambda w: F.size(w) > least)
    read = read.withColumn(sets_, F.transform(units, bigrams))
    whole = F.when((F.size(lines_) > 1) & (F.size(known_) >= least), F.array(F.array_distinct(pairs_))).otherwise(F.expr("cast(array() as array<array<string>>)"))
    read = read.withColumn(whole_, whole)

    def scores(unit: Column) -> Column:
        near = F.filter(given, lambda t: (F.size(unit) >= t["low"]) & (F.size(unit) <= t["high"]))
        all_ = F.transform(near, lambda t: F.struct(dice(unit, t["grams"]).alias("dice"), t["name"].alias("name")))
        return F.filter(all_, lambda s: s["dice"] >= threshold)

    def best_window(t: Column) -> Column:
        starts = F.filter(F.transform(F.col(pairs_), lambda g, i: F.when(F.array_contains(t["grams"], g), i + 1)), lambda i: i.isNotNull())
        return F.array_max(F.transform(starts, lambda i: dice(F.array_distinct(F.slice(F.col(pairs_), i, t["length"])), t["grams"])))

    read = read.withColumn(found_, F.filter(F.transform(F.concat(sets_, whole_), scores), lambda s: F.size(s) > 0))
    some = F.filter(given, lambda t: F.size(F.array_intersect(F.col(known_), t["grams"])) >= t["low"])
    none = F.expr("cast(array() as array<struct<dice:double,name:string>>)")
    seen = F.transform(some, lambda t: F.struct(best_window(t).alias("dice"), t["name"].alias("name")))
    read = read.withColumn(windows_, F.when(F.size(known_) >= least, F.filter(seen, lambda s: s["dice"] >= threshold)).otherwise(none))
    flat = F.concat(F.flatten(found_), F.col(windows_))
    best = F.array_sort(flat, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return read.withColumn(best_, F.try_element_at(best, F.lit(1))).select(
        *docs.columns,
        (F.size(found_) + F.size(windows_)).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(flat, lambda s: s["name"]))), ",").alias("licenses"),
        F.col(best_)["name"].alias("best_license"),
        F.round(F.col(best_)["dice"], 6).alias("best_dice"),
    )
