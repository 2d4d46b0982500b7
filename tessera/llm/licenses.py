"""Licence scan: Dice coefficient over word bigrams against licence templates
(DataFrame operations only).

Each line, each paragraph of several lines, and the whole text of a document of
several paragraphs is a passage. A passage with ``a`` distinct bigrams can reach
coefficient ``t`` with a template of ``b`` only if a*t/(2-t) <= b <= a*(2-t)/t,
so templates outside that size range aren't compared and most passages, being
too long or too short for every template, are never cut into bigrams.

A licence of several paragraphs, or of some lines of one, is a run of lines.
Runs grow from each line with a template's bigram until they have too many
bigrams for any template; those that a shorter or longer run of the same first
or last line betters are left out.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public licence statements and notices, as plain text.
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "MIT-statement-2": "Licensed under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-statement": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-statement": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-statement": "Released under the BSD License.",
    "CC-BY-4.0-statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
}


def words_of(text: str) -> list[str]:
    """The words that both sides are compared by: runs of ASCII letters and
    digits, A-Z lower-cased."""
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() else " " for c in text)
    return out.split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def telling_words(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which any matching passage has one.

    Coefficient ``t`` takes at least b*t/(2-t) of a template's bigrams. Words
    are gathered until, for each template, the bigrams that hold one are more
    than a passage may lack; the rest of the template needn't be looked for. Of
    the words of some length the one that most templates gain by comes first, so
    that few and long words do.
    """
    grams = [[set(g.split(" ")) for g in s] for s in sets.values()]
    lack = [len(s) - math.ceil(len(s) * threshold / (2 - threshold) - 1e-9) for s in grams]
    out: set[str] = set()

    def open_() -> list[list[set[str]]]:
        return [[p for p in s if not p & out] for s, k in zip(grams, lack, strict=True) if sum(1 for p in s if p & out) <= k]

    for least in range(8, 0, -1):
        while left := open_():
            gain: dict[str, int] = {}
            for p in (p for s in left for p in s):
                for w in p:
                    if len(w) >= least:
                        gain[w] = gain.get(w, 0) + 1
            if not gain:
                break
            # short words that gain much are common ones
            out.add(max(gain, key=lambda w: (gain[w] if len(w) > 3 else 0, len(w), w)))
    return sorted(out)


def _one_of(words: list[str]) -> str:
    """A pattern of some words that tries each of their beginnings once."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(w[1:])
    ends = "" in tails
    tails.pop("", None)
    body = "|".join(first + _one_of(rest) for first, rest in sorted(tails.items()))
    return (f"(?:{body})" + "?" * ends) if tails else ""


def _may_match(text: Column, telling: list[str]) -> Column:
    """Whether a text holds one of the words."""
    return text.rlike(f"(?<![A-Za-z0-9])(?i:{_one_of(telling)})(?![A-Za-z0-9])") if telling else F.lit(False)


def _normal(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def passages(docs: DataFrame) -> DataFrame:
    """``doc_id, unit, unit_no, passage``. Paragraphs are set apart by lines
    without characters; a paragraph of one line is given as the line only, a
    text of one paragraph as the paragraph only. A text that is its only line
    is one passage."""
    t = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.split(t, "\n\n+")
    units = F.flatten(F.array(
        F.transform(F.split(t, "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("unit_no"), x.alias("passage"))),
        F.filter(
            F.transform(paragraphs, lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("unit_no"), x.alias("passage"))),
            lambda x: F.contains(x["passage"], F.lit("\n")),
        ),
        F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), t.alias("passage")))).otherwise(
            F.array().cast("array<struct<unit:string,unit_no:int,passage:string>>")
        ),
    ))
    return docs.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.unit_no", "u.passage")


def _grams(w: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def runs(docs: DataFrame, sets: dict[str, list[str]], telling: list[str], high: float) -> DataFrame:
    """``row, doc_id, i, j, no, given, grams``: the runs of lines with words that
    may match, from the i-th to the j-th of a document; no: the first one's
    number among all lines; given: whether the run is a whole paragraph or text.
    A run that opens or closes with a line without a template's bigram is no
    better than the run without that line, and isn't made."""
    t, known = F.col("text"), sorted({g for b in sets.values() for g in b})
    raw = F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("x"))), lambda r: r["x"] != "")
    par = F.flatten(F.transform(F.split(t, "\n\n+"), lambda p, k: F.transform(F.filter(F.split(p, "\n"), lambda x: x != ""), lambda x: k)))
    lines = F.filter(F.zip_with(raw, par, lambda r, p: F.struct(r["no"].alias("no"), p.alias("par"), F.split(_normal(r["x"]), " ").alias("w"))), lambda x: x["w"][0] != "")
    d = docs.where(F.contains("text", F.lit("\n"))).select(F.monotonically_increasing_id().alias("row"), "doc_id", lines.alias("lines"))
    d = d.withColumn("n", F.size("lines")).where("n > 1")
    before = lambda k: F.when(k > 0, F.array(F.element_at(F.get(F.col("lines"), k - 1)["w"], -1))).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("g", F.transform("lines", lambda x, k: _grams(F.concat(before(k), x["w"]))))
    d = d.withColumn("hit", F.transform("g", lambda a: F.exists(a, lambda x: x.isin(known))))
    d = d.withColumn("tell", F.transform("lines", lambda x: F.exists(x["w"], lambda w: w.isin(telling))))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    d = d.withColumn("i", F.explode(F.filter(every, lambda k: F.get("hit", k) | F.coalesce(F.get("hit", k + 1), F.lit(False)))))
    own = _grams(F.get("lines", F.col("i"))["w"])
    # the run has grown enough when it has more bigrams than any match
    last = F.aggregate(
        F.slice("g", F.col("i") + 2, F.col("n")), F.struct(own.alias("seen"), F.col("i").alias("last")),
        lambda s, x: F.when(F.size(s["seen"]) > high, s).otherwise(F.struct(F.array_union(s["seen"], x).alias("seen"), (s["last"] + 1).alias("last"))), lambda s: s["last"])
    told = lambda j: F.exists(F.slice("tell", F.col("i") + 1, j - F.col("i") + 1), lambda x: x)
    d = d.withColumn("last", last).where(told(F.col("last")))
    d = d.withColumn("j", F.explode(F.filter(F.sequence("i", "last"), lambda k: F.get("hit", k)))).where(told(F.col("j")))
    at = lambda k: F.get("lines", k)["par"]
    i, j = F.col("i"), F.col("j")
    paragraph = (at(i) == at(j)) & ((i == 0) | (at(i - 1) != at(i))) & ((j == F.col("n") - 1) | (at(j + 1) != at(j)))
    return d.select(
        "row", "doc_id", "i", "j", F.get("lines", i)["no"].alias("no"), (((i == 0) & (j == F.col("n") - 1)) | F.coalesce(paragraph, F.lit(False))).alias("given"),
        _grams(F.flatten(F.transform(F.slice("lines", i + 1, j - i + 1), lambda x: x["w"]))).alias("grams"))


def best_runs(hits: DataFrame) -> DataFrame:
    """The hits of runs of several lines that neither a run shorter by the next
    step at one end equals nor one longer by it exceeds."""
    out = hits
    for end, order in (("i", F.col("j")), ("j", F.col("i").desc())):
        w = Window.partitionBy("row", "h.license_id", end).orderBy(order)
        out = out.withColumn(f"less_{end}", F.lag("h.score").over(w)).withColumn(f"more_{end}", F.lead("h.score").over(w))
    beaten = reduce(or_, [F.coalesce(F.col(f"less_{e}") >= F.col("h.score"), F.lit(False)) | F.coalesce(F.col(f"more_{e}") > F.col("h.score"), F.lit(False)) for e in "ij"])
    return out.where(~beaten & (F.col("i") < F.col("j")) & ~F.col("given"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, unit, unit_no, license_id, score``: every passage whose Dice
    coefficient with a template is at least ``threshold``; and, as unit ``run``
    with the number of its first line, the best runs of lines that are neither.

    All such templates are given (ties included). Null or empty texts, and
    passages or templates of fewer than two words, match nothing. Repeated rows
    are scanned each. Other columns are ignored; the work grows with the text
    times the templates of a fitting size.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = {k: b for k, v in (templates or TEMPLATES).items() if (b := bigrams_of(v))}
    low = min((len(b) for b in sets.values()), default=1) * threshold / (2 - threshold)
    high = max((len(b) for b in sets.values()), default=0) * (2 - threshold) / threshold
    # texts without any telling word hold no match; the others are cut up
    telling = telling_words(sets, threshold)
    base = base.where(_may_match(F.col("text"), telling))
    whole = base
    units = passages(base).where((F.length("passage") >= low) & _may_match(F.col("passage"), telling))
    units = units.withColumn("norm", _normal(F.col("passage"))).drop("passage")
    units = units.withColumn("n_words", F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).where(F.col("n_words") > low)
    grams = _grams(F.split("norm", " "))
    # a word can repeat, so many words don't bound distinct bigrams from above
    units = units.where(F.col("n_words") >= 2).withColumn("grams", grams).withColumn("a", F.size("grams")).where((F.col("a") >= low) & (F.col("a") <= high)).drop("norm")

    def one(name: str, b: list[str]) -> Column:
        fits = (F.col("a") >= len(b) * threshold / (2 - threshold) - 1e-9) & (F.col("a") <= len(b) * (2 - threshold) / threshold + 1e-9)
        dice = F.size(F.array_intersect("grams", F.array(*map(F.lit, b)))) * 2.0 / (F.col("a") + len(b))
        return F.when(fits, F.struct(F.lit(name).alias("license_id"), dice.alias("score")))

    if not sets:
        return units.select("doc_id", "unit", "unit_no", F.lit("").alias("license_id"), F.lit(0.0).alias("score")).where("false")
    fitting = F.expr(" OR ".join(f"(a >= {len(b) * threshold / (2 - threshold) - 1e-9} AND a <= {len(b) * (2 - threshold) / threshold + 1e-9})" for b in {len(x): x for x in sets.values()}.values()))
    units = units.where(fitting)
    hits = F.filter(F.array(*[one(k, b) for k, b in sets.items()]), lambda x: x["score"] >= threshold - 1e-12)
    found = units.select("doc_id", "unit", "unit_no", F.explode(hits).alias("h"))
    grown = runs(whole, sets, telling, high).withColumn("a", F.size("grams")).where(fitting)
    grown = best_runs(grown.select("row", "doc_id", "i", "j", "no", "given", F.explode(hits).alias("h")))
    found = found.unionAll(grown.select("doc_id", F.lit("run").alias("unit"), F.col("no").alias("unit_no"), "h"))
    return found.select("doc_id", "unit", F.col("unit_no").cast("long").alias("unit_no"), "h.license_id", F.round("h.score", 6).alias("score"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, over all passages and all templates."""
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in bigrams_of(v))) for k, v in TEMPLATES.items())
    norm = "trim(regexp_replace(translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH lic(license_id, b) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_split_to_array(t, '\\n\\n+') AS ps FROM d),
l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
u AS (
  SELECT doc_id, 'line' AS unit, i - 1 AS unit_no, ls[i] AS passage FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
  UNION ALL SELECT doc_id, 'paragraph', i - 1, ps[i] FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p) WHERE contains(ps[i], chr(10))
  UNION ALL SELECT doc_id, 'text', 0, t FROM p WHERE len(ps) > 1
),
w AS (SELECT doc_id, unit, unit_no, string_split({norm}, ' ') AS w FROM u),
g AS (SELECT doc_id, unit, unit_no, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w WHERE len(w) >= 2),
s AS (SELECT doc_id, unit, unit_no, license_id, len(list_intersect(g, b)) * 2.0::DOUBLE / (len(g) + len(b)) AS score FROM g, lic
      WHERE len(g) BETWEEN len(b) * {threshold} / (2 - {threshold}) - 0.001 AND len(b) * (2 - {threshold}) / {threshold} + 0.001)
SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, license_id, round(score::DOUBLE, 6) AS score FROM s WHERE score >= {threshold} - 1e-12
"""
