"""License scans: counted phrases, and an exact containment join of text blocks with license templates.

DataFrame functions only. Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased.

* *Phrases* (base): places where the words of a fixed phrase stand consecutively, counted in every whole text.
* *Templates* (method): a run of a quarter more words than the template has, wherever lines break, matches the
  template when it holds at least ``threshold`` of its distinct words. Each text is cut into blocks of two runs, one run
  apart, so that every run lies in a block. Blocks and templates are joined exactly: words are ordered by their count
  over all documents, rarest first; a matching block must hold one of the template's first ``|T| - need + 1`` words
  (prefix filter), at least ``need`` words (length filter), and enough words must be left behind the first common one
  on both sides (positional filter). What is left is verified for every start of a run at once: a word's place counts
  for the starts after its place before, and sums over these intervals are the runs' overlaps. The work is linear in a
  text, and words that stand farther apart than a run are never counted together.

Defined cases: null text counts as empty; rows are independent, so that ties and repeated rows each get their result;
an empty table gives an empty result; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table, text_or_empty

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: base phrases and their labels
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# fixed values: public license texts that the join looks for, by label; -text: a whole license, the others its notice or a part
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-short": "Licensed under the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "warranty": "The software is provided as is, without warranty of any kind, express or implied",
}

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.85


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SEPARATOR), "")


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted({w for w in re.split(_SEPARATOR, v.lower()) if w}) for k, v in templates.items()}


def run_words(template: str) -> int:
    """Words of the runs that are compared with a template: a quarter more than it has, rounded down."""
    n = len([w for w in re.split(_SEPARATOR, template.lower()) if w])
    return n + n // 4


def _needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Counts over all documents of the templates' words, a bounded list."""
    words = docs.select(F.explode(words_of(lowered(text_or_empty()))).alias("w")).filter(F.col("w").isin(vocabulary))
    return {r["w"]: r["count"] for r in words.groupBy("w").count().collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, word, words, containment).

    A match is the first best run of each stretch of starts whose runs all match; word is its start, words its length."""
    spark = docs.sparkSession
    sets = template_words(templates)
    vocabulary = sorted({w for s in sets.values() for w in s})
    counts = word_counts(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ordered = {k: sorted(s, key=rank.__getitem__) for k, s in sets.items()}
    need = {k: _needed(len(s), threshold) for k, s in ordered.items()}
    rare = sorted({w for k, s in ordered.items() for w in s[: len(s) - need[k] + 1]})
    array = lambda xs: F.array(*map(F.lit, xs))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(lowered(text_or_empty())).alias("words"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("bigint"))
    # each word with a space on either side: places of a phrase share no character
    rows = rows.withColumn("spaced", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    first, last, total, labels = [], [], F.lit(0), []
    for label, phrase in PHRASES.items():
        n = len(phrase.split())
        wrapped = " " + "  ".join(phrase.split()) + " "
        there = F.contains("spaced", F.lit(wrapped))
        in_words = lambda part: F.regexp_count(part, F.lit("[^ ]+")).cast("bigint")
        total += F.when(there, ((F.length("spaced") - F.length(F.replace("spaced", F.lit(wrapped), F.lit("")))) / len(wrapped)).cast("bigint")).otherwise(0)
        first.append(F.when(there, in_words(F.substring_index("spaced", wrapped, 1))))
        last.append(F.when(there, F.col("n_words") - n - in_words(F.substring_index("spaced", wrapped, -1))))
        labels.append(F.when(there, F.lit(label)))
    # a text that holds too few of a template's words has no block that holds enough
    rows = rows.withColumn("held", F.when(F.arrays_overlap("words", array(rare)), F.array_intersect(array(order), F.col("words"))))
    possible = F.array_compact(F.array(*(F.when(F.size(F.array_intersect("held", array(s))) >= need[k], F.lit(k)) for k, s in ordered.items())))
    rows = rows.withColumn("possible", F.when(F.size("held") >= min(need.values(), default=0), possible))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: p["word"].isin(order))
    rows = rows.select(
        "row", "doc_id", "n_words", total.cast("bigint").alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"),
        "possible", F.when(F.size("possible") > 0, places).alias("places"),
    )
    rows = stored(rows, "license-rows")

    index = [(k, i, w, len(s), need[k], run_words(templates[k])) for k, s in ordered.items() for i, w in enumerate(s)]
    index = F.broadcast(spark.createDataFrame(index, "label string, i int, word string, size int, need int, width int"))
    found = rows.filter(F.size("possible") > 0).select("row", "n_words", "places", F.explode("possible").alias("label"))
    found = found.select("row", "n_words", "label", F.explode("places").alias("p")).select("row", "n_words", "label", "p.*").join(index, ["label", "word"])
    # the two blocks that hold a place; a block's runs start in its first half
    half = F.floor(F.col("at") / F.col("width"))
    found = found.withColumn("block", F.explode(F.array(half, half - 1))).filter("block >= 0")
    held = found.groupBy("row", "label", "block").agg(F.min("i").alias("first"), F.countDistinct("i").alias("n"), F.first("size").alias("size"), F.first("need").alias("need"))
    # of the template's words alone: at least need, the first in the prefix, and enough from there on
    kept = held.filter((F.col("first") <= F.col("size") - F.col("need")) & (F.least(F.col("n"), F.col("size") - F.col("first")) >= F.col("need")))
    found = found.join(kept.select("row", "label", "block"), ["row", "label", "block"])
    ends = F.greatest(F.col("n_words") - F.col("width"), F.lit(0))
    before = F.lag("at").over(Window.partitionBy("row", "label", "block", "word").orderBy("at"))
    low = F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("at") - F.col("width") + 1, F.col("block") * F.col("width"))
    high = F.least(F.col("at"), ends, (F.col("block") + 1) * F.col("width") - 1)
    spans = found.select("row", "label", "block", "size", "need", "width", low.alias("low"), high.alias("high")).filter("low <= high")
    steps = spans.select("row", "label", "size", "need", "width", F.explode(F.array(F.struct(F.col("low").alias("a"), F.lit(1).alias("d")), F.struct((F.col("high") + 1).alias("a"), F.lit(-1).alias("d")))).alias("s"))
    # blocks share no start, so that their sums follow one another
    steps = steps.groupBy("row", "label", "size", "need", "width", "s.a").agg(F.sum("s.d").alias("d"))
    along = Window.partitionBy("row", "label").orderBy("a")
    steps = steps.withColumn("n", F.sum("d").over(along)).withColumn("enough", F.col("n") >= F.col("need"))
    steps = steps.withColumn("was", F.lag("enough", 1, False).over(along))
    steps = steps.withColumn("stretch", F.sum(F.when(F.col("enough") & ~F.col("was"), 1).otherwise(0)).over(along)).filter("enough")
    best = F.max(F.struct("n", (-F.col("a")).alias("back"))).alias("best")
    found = steps.groupBy("row", "label", "stretch", "size", "width").agg(best)
    match = F.struct("label", (-F.col("best.back")).cast("int").alias("word"), F.col("width").alias("words"), (F.col("best.n") / F.col("size")).alias("containment"))
    found = found.withColumn("match", match).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("match.containment").alias("best"), F.array_sort(F.collect_list("match")).alias("matches"))
    out = rows.drop("possible", "places").join(found, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        "matches",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def _oracle() -> str:
    """The same result by comparing every run of words with every template."""
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '{_SEPARATOR}'), lambda w: w <> '')"
    sets = ", ".join(f"('{k}', {s}, {_needed(len(s), THRESHOLD)}, {run_words(TEMPLATES[k])})" for k, s in template_words(TEMPLATES).items())
    places = []
    for label, phrase in PHRASES.items():
        tests = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(f"list_filter(range(1, len(words) + 1), lambda i: {tests}) AS \"p_{label}\"")
    every = "list_concat(" + "list_concat(\"p_cc-by\", \"p_gpl\"), \"p_reserved\")"
    base = ", ".join(f"CASE WHEN len(\"p_{k}\") > 0 THEN '{k}' END" for k in PHRASES)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
         translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents
), w AS (SELECT row, doc_id, text, {words("text")} AS words FROM t
), p AS (SELECT row, doc_id, len(words) AS n_words, {", ".join(places)} FROM w
), b AS (
  SELECT row, doc_id, n_words, len({every}) AS n_base, list_min({every}) - 1 AS first_word, list_max({every}) - 1 AS last_word,
         list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p
), templates(label, template, need, width) AS (VALUES {sets}
), possible AS (
  SELECT row, label, template, need, width, words FROM w, templates WHERE len(list_intersect(list_distinct(words), template)) >= need
), runs AS (
  SELECT row, label, template, need,
         unnest(list_transform(range(0, greatest(len(words) - width, 0) + 1), lambda a: len(list_intersect(list_distinct(words[a + 1:a + width]), template)))) AS held
  FROM possible
), found AS (SELECT row, label, max(held / len(template)) AS containment FROM runs WHERE held >= need GROUP BY row, label
), best AS (SELECT row, list(label) AS more, max(containment) AS best FROM found GROUP BY row)
SELECT doc_id, n_words, n_base, first_word, last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
       greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM b LEFT JOIN best USING (row)
"""


ORACLE = _oracle()
