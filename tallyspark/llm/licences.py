"""Licence notices and texts in documents, by Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import lower_ascii

#: Notices and whole texts of common public licences; a parameter.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
)
DICE = 0.8


def normal_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def bigrams(words: Column) -> Column:
    """The different pairs of neighbouring words; none for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat(p["a"], F.lit(" "), p["b"])))


def python_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _known(templates, least: float) -> list[tuple[str, int, list[str], int]]:
    """(licence, number, bigrams, fewest): a window that reaches ``least`` shares ``fewest`` bigrams with the template at least."""
    known = [(name, k, python_bigrams(t)) for k, (name, t) in enumerate(templates)]
    return [(n, k, g, math.ceil(len(g) * least / (2 - least) - 1e-9)) for n, k, g in known if g]


def _most_words(templates, least: float) -> int:
    """Words of a window over several lines, at most: those of the longest template by the same bound as its bigrams."""
    longest = max(len("".join(c if c.isascii() and c.isalnum() else " " for c in t).split()) for _, t in templates)
    return math.floor(longest * (2 - least) / least)


def notices(docs: DataFrame, templates=TEMPLATES, least: float = DICE, text: str = "text") -> DataFrame:
    """(doc_id, line_no, last_line, licence, template, dice): windows of whole lines of each whole text that are like a template by ``least`` or more.

    A window begins and ends with a line that has a bigram of the template, and over several lines has 1.5 times the words of the longest template at most (at a coefficient of 0.8).
    Bigrams go over the ends of lines within it. Of windows that overlap the one of greatest coefficient stays (of equal ones the shorter, then the first by line, then by template); windows
    that overlap a better one go.

    A window of a bigrams and a template of b can reach a coefficient t only if b t / (2 - t) <= a <= b (2 - t) / t, and if it shares b t / (2 - t) of them. So a document
    is compared only with templates of which its whole text has so many bigrams, and a window only with those within the bounds. Lines are cut at line feeds
    and count from 0; null and empty texts have none; repeated rows each give theirs. A very long text is one row's arrays; an empty table gives no rows. Other columns are not read.
    """
    known = _known(templates, least)
    every = F.array(*[F.lit(g) for g in sorted({g for x in known for g in x[2]})])
    tables = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(k).alias("template"), F.array(*map(F.lit, g)).alias("grams"), F.lit(f).alias("fewest")) for n, k, g, f in known])
    most = _most_words(templates, least)

    def possible(shared: Column) -> Column:
        return F.filter(tables, lambda t: F.size(F.array_intersect(shared, t["grams"])) >= t["fewest"])

    whole = once(normal_words(F.col("_text")), lambda w: once(F.array_intersect(bigrams(w), every), possible))
    read = docs.select("doc_id", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")).withColumn("_templates", F.filter(F.array(whole), lambda t: F.size(t) > 0))
    # the array keeps the optimizer from computing the templates again for the filter
    few = read.select("doc_id", "_text", F.explode("_templates").alias("_templates"))
    lines = few.select("doc_id", "_templates", F.transform(F.split("_text", "\n"), normal_words).alias("_lines"))
    ends = F.aggregate("_lines", F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(w))))
    lines = lines.withColumn("_ends", ends)

    def windows(t: Column) -> Column:
        seeds = F.filter(F.transform("_lines", lambda w, i: F.when(F.arrays_overlap(bigrams(w), t["grams"]), i)), lambda i: i.isNotNull())

        def window(i: Column, j: Column) -> Column:
            def compared(g: Column) -> Column:
                a, b = F.size(g), F.size(t["grams"])
                fits = (a >= b * least / (2 - least)) & (a <= b * (2 - least) / least)
                dice = F.when(fits, F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (a + b))
                return F.struct(dice.alias("dice"), i.alias("line_no"), j.alias("last_line"), t["licence"].alias("licence"), t["template"].alias("template"))

            return once(bigrams(F.flatten(F.slice("_lines", i + 1, j - i + 1))), compared)

        near = lambda s, i: F.filter(s, lambda j: (j == i) | ((j > i) & (F.get("_ends", j + 1) - F.get("_ends", i) <= most)))
        return once(seeds, lambda s: F.filter(F.flatten(F.transform(s, lambda i: F.transform(near(s, i), lambda j: window(i, j)))), lambda x: x["dice"] >= least))

    def better(v: Column, w: Column) -> Column:
        order = lambda x: F.struct((-x["dice"]).alias("d"), (x["last_line"] - x["line_no"]).alias("n"), x["line_no"].alias("i"), x["template"].alias("t"))
        return (v["line_no"] <= w["last_line"]) & (w["line_no"] <= v["last_line"]) & (order(v) < order(w))

    found = once(F.flatten(F.transform("_templates", windows)), lambda ws: F.filter(ws, lambda w: ~F.exists(ws, lambda v: better(v, w))))
    return lines.select("doc_id", F.inline(found)).select("doc_id", "line_no", "last_line", "licence", "template", "dice")


def op9_licence_dice(spark, sf_dir) -> DataFrame:
    """One row per window of a document's lines that is a licence notice or text."""
    from tallyspark.llm.common import table

    return notices(table(spark, sf_dir, "documents"))


def oracle_sql(templates=TEMPLATES, least: float = DICE) -> str:
    values = ", ".join("('{}', {}, [{}])".format(n, k, ", ".join(f"'{g}'" for g in grams)) for n, k, grams, _ in _known(templates, least))
    return f"""
WITH t(licence, template, grams) AS (VALUES {values}),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, ls FROM l),
w AS (SELECT doc_id, (i - 1)::INTEGER AS line_no, regexp_extract_all(regexp_replace(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), '[a-z0-9]+') AS ws FROM p),
c AS (SELECT *, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY line_no) AS until FROM w),
g AS (SELECT doc_id, line_no, until, until - len(ws) AS since, list_distinct([ws[j] || ' ' || ws[j + 1] for j in generate_series(1, len(ws) - 1)]) AS gs FROM c WHERE len(ws) >= 2),
s AS (SELECT doc_id, line_no, since, until, licence, template, grams FROM g, t WHERE list_has_any(gs, grams)),
x AS (SELECT a.doc_id, a.line_no, b.line_no AS last_line, a.licence, a.template, a.grams FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.template = b.template AND (b.line_no = a.line_no OR b.line_no > a.line_no AND b.until - a.since <= {_most_words(templates, least)})),
f AS (SELECT x.doc_id, x.line_no, last_line, any_value(licence) AS licence, template, any_value(grams) AS grams, flatten(list(ws ORDER BY w.line_no)) AS ws FROM x JOIN w ON w.doc_id = x.doc_id AND w.line_no BETWEEN x.line_no AND last_line GROUP BY x.doc_id, x.line_no, last_line, template),
h AS (SELECT *, list_distinct([ws[j] || ' ' || ws[j + 1] for j in generate_series(1, len(ws) - 1)]) AS gs FROM f),
d AS (SELECT doc_id, line_no, last_line, licence, template, 2.0::DOUBLE * len(list_intersect(gs, grams)) / (len(gs) + len(grams)) AS dice FROM h),
e AS (SELECT * FROM d WHERE dice >= {least})
SELECT doc_id, line_no, last_line, licence, template::INTEGER AS template, dice FROM e WHERE NOT EXISTS (SELECT 1 FROM e v WHERE v.doc_id = e.doc_id AND v.line_no <= e.last_line AND e.line_no <= v.last_line
  AND (-v.dice, v.last_line - v.line_no, v.line_no, v.template) < (-e.dice, e.last_line - e.line_no, e.line_no, e.template))
"""
