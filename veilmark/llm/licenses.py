"""License scan: phrase places, and an exact set-similarity join of text blocks with license templates.

A word is a maximal run of 0-9, a-z and characters beyond ASCII after lower-casing A-Z; a block is a line of the text, or a
paragraph (a run of non-blank lines) of several lines, as which a notice stands in files. A template matches a block
holding at least `threshold` of its distinct words; a template of fewer than LONG distinct words is one line and is compared
with lines only.
Template words are ordered by their document frequency over the whole corpus, rarest first. A block can match only
if it holds a word of the template's prefix (all but the last ceil(t*|T|) - 1 words), if it has
enough words (length filter), and if enough words are left behind the first shared one in either order
(positional filter); survivors are verified on the full sets. Blocks without any prefix word never leave their row,
so only candidate blocks are exploded, and the templates, a fixed table, are the only broadcast side.

All steps are DataFrame functions. Defined cases: null text counts as empty; repeated rows get equal
results; words of equal frequency are ordered by themselves; texts of any length are read whole; columns other than doc_id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences and whole notices by which public licenses are applied.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-notice",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
THRESHOLD = 0.8
LONG = 12
#: What parts paragraphs: a line break, white space with a further line break or nothing in it, and a line break.
BLANK = "\\n[\\x09-\\x0D\\x20]*\\n"


def _words_of(text: str) -> list[str]:
    return sorted(set("".join(c if c in LOWER or c.isdigit() else " " for c in text.lower()).split()))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _phrases(words: Column) -> list[Column]:
    """Columns n_base, first_word, last_word and base_labels; every word stands between its own two spaces."""
    line = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    spaces = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        mark = f" {'  '.join(parts)} "
        n = ((F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))) / len(mark)).cast("long")
        found = F.contains(line, F.lit(mark))
        counts.append(F.when(found, n).otherwise(0))
        firsts.append(F.when(found, spaces(F.substring_index(line, mark, 1))))
        lasts.append(F.when(found, F.size(words) - len(parts) - spaces(F.substring_index(line, mark, -1))).cast("long"))
        labels.append(F.when(found, F.lit(label)))
    return [sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base")]


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, label, containment), one row a document, text key and label whose block matches.

    docs has doc_id, text and key. Every qualifying pair of block and template is found.
    """
    spark = docs.sparkSession
    sets = [(label, _words_of(text)) for label, text in (TEMPLATES if templates is None else templates)]
    vocabulary = sorted({w for _, words in sets for w in words})
    low = docs.select("doc_id", "key", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    # At most one row for each template word reaches the driver.
    frequency = dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in low.select(F.explode(F.array_intersect(F.split("low", GAP), known)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (frequency[w], w))
    rank = {w: i for i, w in enumerate(order)}
    ordered = [(k, label, sorted(words, key=rank.__getitem__)) for k, (label, words) in enumerate(sets)]
    prefixes = [(w, k, label, i, len(words), ceil(threshold * len(words) - 1e-9), words) for k, label, words in ordered for i, w in enumerate(words[: len(words) - ceil(threshold * len(words) - 1e-9) + 1])]
    rare = sorted({p[0] for p in prefixes})
    by_rank = F.array(*[F.lit(w) for w in order])

    holds = lambda words: lambda x: x.rlike(r"(?<![0-9a-z\x{80}-\x{10FFFF}])(?:" + "|".join(words) + r")(?![0-9a-z\x{80}-\x{10FFFF}])")
    part = lambda blocks, several: F.transform(blocks, lambda x: F.struct(F.lit(several).alias("several"), x.alias("line")))
    lines = part(F.filter(F.split("low", "\n"), holds(rare)), False)
    long_rare = sorted({p[0] for p in prefixes if p[4] >= LONG})
    paragraphs = F.filter(F.split("low", BLANK), lambda x: F.contains(x, F.lit("\n")) & (holds(long_rare)(x) if long_rare else F.lit(False)))
    blocks = low.select("doc_id", "key", F.posexplode(F.concat(lines, part(paragraphs, True))).alias("block", "b"))
    blocks = blocks.select("doc_id", "key", "block", "b.several", F.array_intersect(by_rank, F.split("b.line", GAP)).alias("words"))
    probes = blocks.select("doc_id", "key", "block", "several", "words", F.posexplode("words").alias("j", "token"))
    table = spark.createDataFrame(prefixes, "token string, template int, label string, i int, size int, need int, full array<string>")
    pairs = probes.join(F.broadcast(table), "token")
    pairs = pairs.where((F.size("words") >= F.col("need")) & (~F.col("several") | (F.col("size") >= LONG)))
    pairs = pairs.where(F.least("i", "j") + F.least(F.col("size") - F.col("i"), F.size("words") - F.col("j")) >= F.col("need"))
    shared = F.size(F.array_intersect("words", "full"))
    pairs = pairs.withColumn("shared", shared).where("shared >= need")
    return pairs.groupBy("doc_id", "key", "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    score is the best containment of a matching template, 1 where a base phrase stands, else 0.
    """
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    words = docs.select("doc_id", "key", _split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)).alias("words"))
    base = words.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), *_phrases(F.col("words")))
    found = template_matches(docs, templates, threshold).groupBy("doc_id", "key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "own", "best")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    own = F.coalesce("own", F.expr("cast(array() as array<string>)"))
    comma = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", comma(F.col("base")).alias("base_labels"), comma(F.concat("base", own)).alias("labels"), score.alias("score"))


def oracle_sql() -> str:
    """The same scan over documents as one DuckDB statement, comparing every line and paragraph with every template."""
    gap = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    rows = ", ".join(f"('{label}', [{', '.join(repr(w) for w in _words_of(text))}])" for label, text in TEMPLATES)
    places = " UNION ALL ".join(f"SELECT r, '{label}' AS label, unnest(range(0, len(words) - {n} + 1)) AS pos, {n} AS n, {repr(phrase.split())} AS p, words FROM split" for phrase, label in PHRASES.items() for n in [len(phrase.split())])
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
split AS (SELECT r, doc_id, low, list_filter(string_split_regex(low, '{gap}'), lambda w: w <> '') AS words FROM base),
templates(label, full_set) AS (VALUES {rows}),
places AS (SELECT r, label, pos FROM ({places}) WHERE words[pos + 1 : pos + n] = p),
phrase AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY r),
blocks AS (
  SELECT r, false AS several, list_distinct(string_split_regex(x, '{gap}')) AS ws FROM (SELECT r, unnest(string_split(low, chr(10))) AS x FROM split)
  UNION ALL SELECT r, true, list_distinct(string_split_regex(x, '{gap}')) FROM (SELECT r, unnest(string_split_regex(low, '{BLANK}')) AS x FROM split) WHERE contains(x, chr(10))),
matched AS (
  SELECT r, label, len(list_intersect(ws, full_set)) / len(full_set) AS c FROM blocks CROSS JOIN templates
  WHERE len(list_intersect(ws, full_set)) >= ceil({THRESHOLD} * len(full_set) - 1e-9) AND (NOT several OR len(full_set) >= {LONG})),
own AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS best FROM matched GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(phrase.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(phrase.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(phrase.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  CASE WHEN phrase.n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.best, 0.0)::DOUBLE END AS score
FROM split LEFT JOIN phrase USING (r) LEFT JOIN own USING (r)"""
