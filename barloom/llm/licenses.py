"""Licence scans: parts of documents compared with licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike: ASCII letters in lower case and digits make words, all else separates them. A
document is scanned line by line, paragraph by paragraph (blank lines separate; those of several lines) and whole (if it
has several lines). Part a and template b match when 2 |a & b| / (|a| + |b|) over their sets of bigrams reaches the
threshold t. That needs |a| between t / (2 - t) and (2 - t) / t times |b|: a template is filed under every size in its
bounds, and a part meets only the templates filed under its own size, by an equi-join with that table. The table has
a fixed number of templates, so its size is bounded whatever the corpus, and it is broadcast. Nothing is shuffled.

Null text has no parts; parts with fewer than two words match nothing. Repeated rows are reported each. A part may match
several templates; all are reported. An empty table gives an empty result. Other columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8

# Notices by which works name their licence, and the opening or full terms of short licences.
TEMPLATES = {
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense terms": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    """Runs of ASCII letters (lower case) and digits."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct hashes of adjacent words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))


def template_table(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    """template, t_grams, and n: a row for each size that a matching part may have."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, t_text string").withColumn("t_words", words_of(F.col("t_text")))
    rows = rows.select("template", bigrams_of(F.col("t_words")).alias("t_grams"), F.size("t_words").alias("_n")).withColumn("_m", F.size("t_grams")).filter("_m > 0")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    # Rounded outwards by a little: the bounds only prune.
    sizes = F.sequence(F.ceil(F.col("_m") * low - 1e-9).cast("int"), F.floor(F.col("_m") * high + 1e-9).cast("int"))
    return rows.select("template", "t_grams", F.explode(sizes).alias("t_n"))


def parts_of(text: Column) -> Column:
    """Structs (part, number, text) of a text: lines, paragraphs of several lines, the whole if it has several lines."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("part"), i.alias("number"), x.alias("body")))
    paragraphs = F.transform(F.split(text, "\n[\\x20\\x09-\\x0D]*\n"), lambda x, i: F.struct(F.lit("paragraph").alias("part"), i.alias("number"), x.alias("body")))
    several = F.size(paragraphs) > 1
    paragraphs = F.filter(F.when(several, paragraphs).otherwise(F.slice(paragraphs, 1, 0)), lambda p: F.instr(p.body, "\n") > 0)
    whole = F.filter(F.array(F.struct(F.lit("text").alias("part"), F.lit(0).alias("number"), text.alias("body"))), lambda p: F.instr(p.body, "\n") > 0)
    return F.concat(lines, paragraphs, whole)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, number (of the part, from 0), template, n_bigrams, n_shared, dice: one row for each match."""
    table = template_table(docs.sparkSession, templates, threshold)
    parts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.explode(parts_of(F.col(text))).alias("p")).select("_key", "p.*")
    worded = parts.withColumn("_words", words_of(F.col("body")))
    # Not nullable, so that no null test of the join key is pushed down, which would compute it twice.
    sized = worded.withColumn("_grams", bigrams_of(F.col("_words"))).withColumn("_n", F.coalesce(F.size("_grams"), F.lit(0)))
    met = sized.join(F.broadcast(table), F.col("_n") == F.col("t_n"))
    shared = met.withColumn("n_shared", F.size(F.array_intersect("_grams", "t_grams"))).withColumn("_t", F.size("t_grams"))
    dice = 2 * F.col("n_shared") / (F.col("_n") + F.col("_t"))
    return shared.filter(dice >= threshold).select(F.col("_key").alias(key), "part", F.col("number").cast("long").alias("number"), "template", F.col("_n").cast("long").alias("n_bigrams"), F.col("n_shared").cast("long").alias("n_shared"), dice.alias("dice"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir))
    return found.select("doc_id", "part", "number", "template", "n_bigrams", "n_shared", F.round("dice", 6).alias("dice"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n  ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(TEMPLATES.items()))
    grams = "list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "list_filter(string_split(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH t(template, body) AS (VALUES
  {values}),
tg AS (SELECT template, {grams} AS tg FROM (SELECT template, {words.format('body')} AS w FROM t)),
l AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n') AS b, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, 'line' AS part, unnest(a) AS body, generate_subscripts(a, 1) - 1 AS number FROM l
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(b) AS body, generate_subscripts(b, 1) - 1 FROM l WHERE len(b) > 1) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', text, 0 FROM l WHERE contains(text, chr(10))),
g AS (SELECT doc_id, part, number, {grams} AS g FROM (SELECT doc_id, part, number, {words.format('body')} AS w FROM p) WHERE len(w) > 1),
m AS (SELECT doc_id, part, number, template, len(g) AS n_bigrams, len(tg) AS nt, len(list_intersect(g, tg)) AS n_shared
  FROM g JOIN tg ON 5 * len(g) >= 3 * len(tg) AND 2 * len(g) <= 3 * len(tg) + 1)
SELECT doc_id, part, number, template, n_bigrams, n_shared, round(2 * n_shared / (n_bigrams + nt), 6) AS dice
FROM m WHERE 2 * n_shared / (n_bigrams + nt) >= {THRESHOLD}
"""


OP1_SQL = _sql()
