"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams, with DataFrame operations only.

Every line of a text, and the whole text where it has several lines, is a unit, and so is every other run of words with no more
bigrams than a template accepts: a notice over several lines, or within a longer one. Only templates whose bigram count can still
reach the threshold with the unit's own count are compared; the counts that a template accepts are listed, so this is a hash
join on the count and not a comparison of every unit with every template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .licence_texts import MORE

#: Least Dice coefficient, in hundredths.
PERCENT = 90

#: Notices and short licences as their holders publish them.
TEMPLATES = {
    "Apache-2.0 (reference)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT (reference)": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0 (reference)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 (reference)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (reference)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause (reference)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Unlicense (notice)": "This is free and unencumbered software released into the public domain.",
    "All rights reserved": "All rights reserved.",
}
TEMPLATES |= {k: v for k, v in MORE.items() if k not in TEMPLATES}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as texts are."""
    w = re.sub(r"[^a-z0-9]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _accepted(size: int, percent: int) -> list[int]:
    """Bigram counts n for which 2 * min(n, size) / (n + size) reaches the threshold."""
    return [n for n in range(1, 2 * size * 100 // percent + 1) if 200 * min(n, size) >= percent * (n + size)]


def _words(unit: Column) -> Column:
    ascii_low = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.trim(F.regexp_replace(ascii_low, "[^a-z0-9]+", " ")), " ")


def _hashes(w: Column) -> Column:
    return F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.concat(F.get(w, i), F.lit(" "), x)))


def _runs(df: DataFrame, sets: dict[str, list[str]], counts: dict[str, list[int]], percent: int) -> DataFrame:
    """The best run of words of each place where some reach the threshold and neither a line in it nor the whole text does; line is where it begins.

    Texts that lack too many of a template's bigrams are left out first. A run has at most as many bigrams, repeats counted, as the
    template accepts; runs begin and end with bigrams of the template, as others only lower the coefficient.
    """
    spark = df.sparkSession
    # a match shares percent / 200 of the two counts, and its own count is the least accepted or more
    least = {k: -(-percent * (len(sets[k]) + counts[k][0]) // 200) for k in sets if counts[k]}
    rows = [(k, sets[k], least[k], counts[k][-1]) for k in least]
    known = spark.createDataFrame(rows, "licence string, wanted array<string>, least int, most int").select("licence", "least", "most", F.array_distinct(F.transform("wanted", lambda x: F.xxhash64(x))).alias("wanted"))
    every = known.agg(F.collect_list(F.struct("licence", "least", "most", "wanted")).alias("known"), F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("any"))
    words = df.where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(_words(F.col("text")))).alias("w")).where(F.size("w") > min(least.values(), default=0))
    hits = words.select("doc_id", "text", F.explode(F.array(_hashes(F.col("w")))).alias("h")).join(F.broadcast(every))
    hits = hits.select("doc_id", "text", "known", F.explode(F.array(F.array_intersect("h", "any"))).alias("hits")).where(F.size("hits") >= min(least.values(), default=1))
    some = F.filter("known", lambda k: (k["least"] <= F.size("hits")) & (F.size(F.array_intersect(k["wanted"], "hits")) >= k["least"]))
    found = hits.select("doc_id", "text", F.explode(some).alias("k"))
    # all bigrams of those texts: line, place, whether the template has it, and where the text had it last
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.filter(_words(x), lambda y: y != "").alias("w"))), lambda x: F.size(x["w"]) > 0)
    flat = F.flatten(F.transform(lines, lambda x: F.transform(x["w"], lambda y: F.struct(x["line"].alias("line"), y.alias("word")))))
    flat = found.select("doc_id", "k", F.explode(F.array(flat)).alias("f"))
    nxt = F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))
    seq = F.transform(nxt, lambda x, i: F.struct(F.get("f", i)["line"].alias("line"), x["line"].alias("to"), F.xxhash64(F.concat(F.get("f", i)["word"], F.lit(" "), x["word"])).alias("h")))
    own = flat.select("doc_id", "k", F.explode(F.array(seq)).alias("seq"))
    share = lambda a, k: F.size(F.array_intersect(a, k["wanted"]))
    reaches = lambda a, k: 200 * share(a, k) >= percent * (F.size(F.array_distinct(a)) + F.size(k["wanted"]))
    whole = F.transform("seq", lambda x: x["h"])
    own = own.where(~reaches(whole, F.col("k")))
    # lines that match by themselves
    numbers = F.array_distinct(F.transform(F.filter("seq", lambda x: F.array_contains(F.col("k.wanted"), x["h"])), lambda x: x["line"]))
    single = lambda n: F.transform(F.filter("seq", lambda x: (x["line"] == n) & (x["to"] == n)), lambda x: x["h"])
    own = own.withColumn("single", F.filter(numbers, lambda n: reaches(single(n), F.col("k"))))
    # where the text had each bigram before: it counts in a run only if that is before the run
    flat = own.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "k", "single", F.posexplode("seq").alias("i", "x"))
    before = F.coalesce(F.lag("i").over(Window.partitionBy("row", "x.h").orderBy("i")), F.lit(-1))
    item = F.struct("i", "x.line", "x.to", F.array_contains("k.wanted", F.col("x.h")).alias("hit"), before.alias("before"))
    flat = flat.select("row", "doc_id", F.col("k.licence").alias("licence"), F.size("k.wanted").alias("n_template"), F.col("k.most").alias("most"), "single", item.alias("x"))
    text = flat.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "licence", "n_template", "most", "single")), F.array_sort(F.collect_list("x")).alias("seq"))
    at = text.select(*(c for c in text.columns if c != "seq"), F.explode(F.filter("seq", lambda x: x["hit"])).alias("s"), "seq").withColumn("start", F.col("s.i"))
    size = F.col("n_template")
    none = F.struct(*(F.lit(0).alias(c) for c in ("shared", "n_unit", "best_shared", "best_n", "end", "to")))

    def step(a: Column, x: Column) -> Column:
        new = x["before"] < F.col("start")
        shared, n = a["shared"] + (new & x["hit"]).cast("int"), a["n_unit"] + new.cast("int")
        better = x["hit"] & (200 * shared >= percent * (n + size)) & (shared * (a["best_n"] + size) > a["best_shared"] * (n + size))
        pick = lambda y, old: F.when(better, y).otherwise(a[old]).alias(old)
        return F.struct(shared.alias("shared"), n.alias("n_unit"), pick(shared, "best_shared"), pick(n, "best_n"), pick(x["i"] + 1, "end"), pick(x["to"], "to"))

    best = at.withColumn("m", F.explode(F.array(F.aggregate(F.slice("seq", F.col("start") + 1, F.col("most")), none, step)))).drop("seq").where("m.best_shared > 0")
    best = best.select("row", "doc_id", "licence", "n_template", "single", "start", "m.end", "m.to", F.col("s.line").alias("line"), F.col("m.best_shared").alias("shared"), F.col("m.best_n").alias("n_unit"))
    best = best.withColumn("dice", F.col("shared") / (F.col("n_unit") + F.col("n_template")))
    best = best.where(~F.exists("single", lambda n: n.between(F.col("line"), F.col("to")))).drop("single")
    # runs that overlap are one place, the best of them stands for it
    w = Window.partitionBy("row", "licence").orderBy("start")
    best = best.withColumn("new", F.coalesce((F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    best = best.withColumn("place", F.sum("new").over(w))
    top = best.groupBy("row", "licence", "place").agg(F.max(F.struct("dice", (-F.col("start")).alias("first"), "doc_id", "line", "shared", "n_unit", "n_template")).alias("b"))
    return top.select("b.doc_id", "b.line", "licence", "b.shared", "b.n_unit", "b.n_template")


def licence_matches(df: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line, licence, shared, n_unit, n_template): every unit of df and template with a Dice coefficient of percent / 100 or more.

    df: doc_id, text, other columns ignored. line counts from 1; 0 is the whole text. A run of words that is neither has the line where it begins. Bigrams count once each. Null and empty
    texts and units of fewer than two words match nothing; a null doc_id is kept as null; repeated rows give repeated matches.
    """
    spark = df.sparkSession
    sets = {name: bigrams(t) for name, t in (templates or TEMPLATES).items()}
    counts = {name: _accepted(len(b), percent) for name, b in sets.items()}
    hashes = F.array_distinct(F.transform("wanted", lambda x: F.xxhash64(x)))
    known = spark.createDataFrame([(k, sets[k], n) for k in sets for n in counts[k]], "licence string, wanted array<string>, n_unit int").select("licence", "n_unit", hashes.alias("wanted"))
    low, high = min((n for c in counts.values() for n in c), default=1), max((n for c in counts.values() for n in c), default=0)
    lines = F.split("text", "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("unit"))))
    each = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    # a unit of fewer than low + 1 words has too few bigrams for any template, and so has one of fewer characters
    long_enough = F.filter(F.concat(each, F.coalesce(whole, F.array().cast("array<struct<line:int,unit:string>>"))), lambda x: F.length(x["unit"]) >= 2 * low + 1)
    parts = df.where("text IS NOT NULL").select("doc_id", F.explode(long_enough).alias("p"))
    words = parts.select("doc_id", "p.line", F.explode(F.array(_words(F.col("p.unit")))).alias("w")).where(F.size("w") > low)
    # bigrams are compared as 64-bit hashes: sets of numbers are made in linear time
    pairs = F.array_distinct(F.transform(F.slice("w", 2, F.size("w") - 1), lambda x, i: F.xxhash64(F.concat(F.get("w", i), F.lit(" "), x))))
    units = words.select("doc_id", "line", F.explode(F.array(pairs)).alias("own")).where(F.size("own").between(low, high))
    shared = F.size(F.array_intersect("own", "wanted"))
    joined = units.withColumn("n_unit", F.size("own")).join(F.broadcast(known), "n_unit").withColumn("shared", shared).withColumn("n_template", F.size("wanted"))
    alone = joined.where(200 * F.col("shared") >= percent * (F.col("n_unit") + F.col("n_template"))).select("doc_id", "line", "licence", "shared", "n_unit", "n_template")
    return alone.unionByName(_runs(df, sets, counts, percent))


def licence_scan(df: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """Every row of df's doc_id with n_matches and licences, an array of (line, licence, dice) in order.

    Rows that repeat a doc_id each have the matches of all of them, once. A document without matches, and one without doc_id, has none.
    """
    m = licence_matches(df.where("doc_id IS NOT NULL"), templates, percent)
    dice = F.round(200 * F.col("shared") / (F.col("n_unit") + F.col("n_template"))).cast("int")
    per = m.select("doc_id", F.struct("line", "licence", dice.alias("dice")).alias("m")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("m")).alias("licences"))
    out = df.select("doc_id").join(per, "doc_id", "left")
    none = F.array().cast(per.schema["licences"].dataType)
    return out.withColumn("licences", F.coalesce("licences", none)).withColumn("n_matches", F.size("licences").cast("long"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents: doc_id, n_matches and licences as line:licence:dice, joined by semicolons."""
    out = licence_scan(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["line"].cast("string"), x["licence"], x["dice"].cast("string"))), ";")
    return out.select("doc_id", "n_matches", text.alias("licences"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP10_SQL = f"""
WITH templates AS (
  SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, [{', '.join(map(_quoted, bigrams(v)))}])" for k, v in TEMPLATES.items())}) t(licence, wanted)
), lines AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))
), words AS (
  SELECT doc_id, line, list_filter(string_split(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM lines
), units AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM words WHERE len(w) > 1
), compared AS (
  SELECT doc_id, line, licence, len(list_intersect(own, wanted)) AS shared, len(own) + len(wanted) AS total FROM units JOIN templates ON 200 * least(len(own), len(wanted)) >= {PERCENT} * (len(own) + len(wanted))
), per AS (
  SELECT doc_id, COUNT(*) AS n_matches, string_agg(line || ':' || licence || ':' || CAST(round(200.0 * shared / total) AS INT), ';' ORDER BY line, licence) AS licences
  FROM compared WHERE 200 * shared >= {PERCENT} * total GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(n_matches, 0) AS n_matches, COALESCE(licences, '') AS licences FROM documents d LEFT JOIN per USING (doc_id)
"""
