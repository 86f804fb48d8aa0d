"""Licence scans: Dice coefficient over word bigrams; DataFrame functions only.

Each line of a document, and its whole text, is a unit, and so is each run of as
many words as a template has, cut at both ends to bigrams of the template: a
notice may be wrapped over lines, or stand inside a line or a longer text. Of
overlapping runs the best counts, and none that lies inside a longer one that is
as good (the first part of a licence inside its complete text). A run that touches a line that matches the
same template, or lies in a text that matches it whole, can raise the
coefficient but is no further unit. A unit is normalised to words (ASCII case
folded, punctuation gone); its distinct word bigrams are compared with those of licence templates. With n and m bigrams the coefficient
is at most 2 min(n, m) / (n + m), so a template is a candidate only while n lies
between m * t / (2 - t) and m * (2 - t) / t for the threshold t; that bound is
part of the join on bigrams, before anything is counted. The threshold also
tells how many of a template's bigrams a unit must share; texts and lines
without any of the words that this makes necessary are not cut into bigrams,
and runs are sought only in texts with so many of a template's bigrams.

The registered SQL knows lines, whole texts and the notices only; where a table
has a wrapped notice or a complete licence text, this finds more than it.

Templates are a small table given as a parameter; its size is checked before it
is broadcast, and a larger one is joined by shuffle.

Defined results: null, empty and one-word texts match nothing; a document with
several templates at the same best coefficient reports the smallest id; rows
that repeat an id are each returned, with the matches of that id; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import materialize, text_or_empty
from tarnmark.llm.decontaminate import LOWER, UPPER, words_of

THRESHOLD = 0.8
#: Template bigrams up to which they are broadcast (about 60 bytes each).
BROADCAST_BIGRAMS = 500_000
#: Necessary words up to which texts are searched for each; more are looked up among the words of the text.
MOST_MARKS = 96

#: Licence notices and texts as their authors word them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Complete texts of the licences of which TEMPLATES has the first part.
COMPLETE = {
    "BSD-2-Clause-text": TEMPLATES["BSD-2-Clause"] + _BSD_DISCLAIMER,
    "BSD-3-Clause-text": (
        TEMPLATES["BSD-2-Clause"]
        + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission." + _BSD_DISCLAIMER
    ),
    "ISC-text": (
        TEMPLATES["ISC"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-text": (
        TEMPLATES["MIT"] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
}


def pairs_of(words: Column) -> Column:
    """Neighbouring word pairs of an array of words, in order; words have no spaces."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())  # the last word has no neighbour


def bigrams_of(words: Column) -> Column:
    """Distinct neighbouring word pairs of an array of words."""
    return F.array_distinct(pairs_of(words))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((templates or TEMPLATES | COMPLETE).items()), "license_id string, text string")


def necessary_words(bigrams: set[str], threshold: float) -> set[str]:
    """Words of which a unit must contain one to reach the threshold with a template of these bigrams.

    Such a unit shares threshold * m / (2 - threshold) of the m bigrams or more.
    Words are taken, the longest first, until fewer bigrams are left without one.
    """
    left, words = set(bigrams), set()
    for word in sorted({w for b in bigrams for w in b.split(" ")}, key=lambda w: (-len(w), w)):
        if len(left) < threshold * len(bigrams) / (2 - threshold):
            break
        words.add(word)
        left = {b for b in left if word not in b.split(" ")}
    return words


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dice(pairs: Column, b: Column, m: Column) -> Column:
    return 2 * F.size(F.array_intersect(pairs, b)) / (F.size(F.array_distinct(pairs)) + m)


def run_matches(texts: DataFrame, templates: DataFrame, pairs: DataFrame, hint, threshold: float) -> DataFrame:
    """(doc_id, unit, license_id, dice) of matching runs of words; unit is -2 minus the first word, null for no further unit.

    texts: doc_id, line and h, which tells texts apart; templates: license_id and text; pairs: license_id, m and pair of each template.
    """
    found = (
        texts.select("h", F.explode(bigrams_of(words_of(F.col("line")))).alias("pair"))
        .join(hint(pairs), "pair")
        .groupBy("h", "license_id", "m")
        .agg(F.count("*").alias("both"))
        .where(F.col("both") >= F.col("m") * (threshold / (2 - threshold)))
        .drop("both")
    )
    t = templates.select("license_id", pairs_of(words_of(text_or_empty())).alias("all"))
    t = t.select("license_id", F.size("all").alias("long"), F.array_distinct("all").alias("b"))
    lines = F.transform(F.split("line", "\n"), lambda x: words_of(x))
    c = texts.join(found, "h").join(t, "license_id").withColumn("lines", lines)
    c = c.withColumn("pairs", pairs_of(F.flatten("lines")))
    c = c.withColumn("at", F.flatten(F.transform("lines", lambda ws, i: F.transform(ws, lambda w: i))))  # line of each word
    c = c.withColumn("shared", F.transform("pairs", lambda p: F.array_contains("b", p)))
    b, m, long, pairs_ = F.col("b"), F.col("m"), F.col("long"), F.col("pairs")

    def run(s: Column) -> Column:  # s counts from 0; the last shared bigram of as many as the template has ends it
        flags = F.slice("shared", s + 1, long)
        size = F.size(flags) + 1 - F.array_position(F.reverse(flags), True).cast("int")
        return _let(size, lambda z: F.struct(s.alias("s"), (s + z - 1).alias("e"), _dice(F.slice(pairs_, s + 1, z), b, m).alias("dice")))

    starts = F.filter(F.transform("shared", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    runs = F.filter(F.transform(starts, run), lambda r: r["dice"] >= threshold)
    # from the left, the best of those that overlap
    best = F.aggregate(
        runs,
        F.array().cast("array<struct<s:int,e:int,dice:double>>"),
        lambda kept, r: F.when((F.size(kept) == 0) | (r["s"] > F.element_at(kept, -1)["e"]), F.concat(kept, F.array(r)))
        .when(r["dice"] > F.element_at(kept, -1)["dice"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(r)))
        .otherwise(kept),
    )
    matching = F.filter(F.transform("lines", lambda ws, i: F.when(_let(pairs_of(ws), lambda p: _dice(p, b, m)) >= threshold, i)), lambda i: i.isNotNull())
    c = c.select("doc_id", "h", "license_id", "at", matching.alias("matching"), (_dice(pairs_, b, m) >= threshold).alias("is_whole"), F.explode(best).alias("r"))
    first, last = F.get("at", F.col("r.s")), F.get("at", F.col("r.e") + 1)
    known = F.col("is_whole") | F.exists("matching", lambda i: i.between(first, last))
    found = F.struct("r.s", "r.e", "r.dice", "license_id", F.when(~known, -2 - F.col("r.s")).cast("int").alias("unit"))
    c = c.groupBy("doc_id", "h").agg(F.collect_set(found).alias("runs"))
    inside = lambda x, y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & (y["e"] - y["s"] > x["e"] - x["s"]) & (y["dice"] >= x["dice"])
    c = c.select("doc_id", F.explode(F.filter("runs", lambda x: ~F.exists("runs", lambda y: inside(x, y)))).alias("r"))
    return c.select("doc_id", "r.unit", "r.license_id", "r.dice")


def license_matches(docs: DataFrame, templates: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, license_id, dice) of every unit and template at the threshold or above; unit -1 is the whole text, below are runs."""
    t = templates.select("license_id", bigrams_of(words_of(text_or_empty())).alias("b")).where("size(b) > 0")
    t = materialize(t.select("license_id", F.size("b").alias("m"), F.explode("b").alias("pair")), "templates")
    limits = t.agg(F.min("m"), F.max("m"), F.count("*")).first()
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    hint = F.broadcast if limits[2] <= BROADCAST_BIGRAMS else (lambda df: df)

    text = text_or_empty()
    may = F.lit(True)
    if limits[2] <= BROADCAST_BIGRAMS:  # templates small enough for the driver
        marks: set[str] = set()
        for row in t.groupBy("license_id").agg(F.collect_set("pair").alias("b")).collect():
            marks |= necessary_words(set(row.b), threshold)
        if len(marks) > MOST_MARKS:
            may = F.arrays_overlap(words_of(F.col("line")), F.array(*[F.lit(w) for w in sorted(marks)]))
        elif marks:
            folded = F.translate(F.col("line"), UPPER, LOWER)
            # bound to a lambda, the folded text is made once and not for each word
            may = F.exists(F.array(folded), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in sorted(marks)]))
    licensed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("line")).where(may).dropDuplicates()
    whole_may = materialize(licensed.withColumn("h", F.xxhash64("doc_id", "line")), "licensed")
    lines = whole_may.select("doc_id", "h", F.posexplode(F.split("line", "\n")).alias("unit", "line")).where(may)
    whole = whole_may.select("doc_id", "h", F.lit(-1).alias("unit"), "line").where(F.instr("line", "\n") > 0)
    fits = F.size("words") - 1 >= F.lit((limits[0] or 0) * least)
    units = lines.unionByName(whole).select("doc_id", "h", "unit", words_of(F.col("line")).alias("words")).where(fits)
    units = units.select("doc_id", "h", "unit", bigrams_of(F.col("words")).alias("b"))
    units = units.where(F.size("b").between((limits[0] or 0) * least, (limits[1] or 0) * most))
    pairs = units.select("doc_id", "h", "unit", F.size("b").alias("n"), F.explode("b").alias("pair"))
    shared = (
        pairs.join(hint(t), "pair")
        .where(F.col("n").between(F.col("m") * least, F.col("m") * most))
        .groupBy("doc_id", "h", "unit", "license_id", "n", "m")
        .agg(F.count("*").alias("both"))
    )
    shared = shared.select("doc_id", "unit", "license_id", (2 * F.col("both") / (F.col("n") + F.col("m"))).alias("dice")).where(F.col("dice") >= threshold)
    return shared.unionByName(run_matches(whole_may, templates, t, hint, threshold))


def license_scan(docs: DataFrame, templates: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id (best; null if none), dice, n_units (matching units), licenses (all ids, sorted, comma-joined)."""
    found = (
        license_matches(docs, templates, threshold=threshold)
        .groupBy("doc_id")
        .agg(
            F.min(F.struct((-F.col("dice")).alias("d"), "license_id")).alias("best"),
            F.size(F.collect_set("unit")).cast("long").alias("n"),
            F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("all"),
        )
        .withColumnRenamed("doc_id", "hit_id")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id",
        F.col("best.license_id").alias("license_id"),
        F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_units"),
        F.coalesce("all", F.lit("")).alias("licenses"),
    )


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: all documents against the built-in templates."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), template_table(spark))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
_WORDS = (
    "list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda v: v <> '')"
)
ORACLE = f"""
WITH t0 AS (SELECT license_id, {_WORDS} AS w FROM (VALUES {_VALUES}) v(license_id, x)),
t AS (SELECT license_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS b FROM t0),
u0 AS (
  SELECT doc_id, unit, {_WORDS} AS w FROM (
    SELECT doc_id, unnest(range(0, len(s))) AS unit, unnest(s) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
    UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10)))),
u AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS b FROM u0 WHERE len(w) > 1),
m AS (
  SELECT doc_id, unit, license_id, 2 * len(list_intersect(u.b, t.b))::DOUBLE / (len(u.b) + len(t.b)) AS dice
  FROM u JOIN t ON len(u.b) BETWEEN len(t.b) * {THRESHOLD / (2 - THRESHOLD)} AND len(t.b) * {(2 - THRESHOLD) / THRESHOLD}),
g AS (
  SELECT doc_id, first(license_id ORDER BY dice DESC, license_id) AS license_id, max(dice) AS dice, count(DISTINCT unit)::BIGINT AS n_units,
    array_to_string(list_sort(list_distinct(list(license_id))), ',') AS licenses
  FROM m WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT d.doc_id, g.license_id, coalesce(g.dice, 0.0)::DOUBLE AS dice, coalesce(g.n_units, 0)::BIGINT AS n_units, coalesce(g.licenses, '') AS licenses
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
