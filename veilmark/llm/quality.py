"""Heuristic quality rules: a threshold table compiled into native Spark projections.

A word is a run of characters other than space and U+0009 to U+000D. Every statistic is a column of a few
projections over the text (no user functions, no shuffle), so the operator is one scan; RULES holds the bounds
that a document must keep, each a ratio of two statistics.

Repeated three-word windows are found inside one row: windows sort by a 64-bit hash of their words, equal
neighbours mark positions, and the marked spans are summed, n log n in a document's words.

Defined cases: null or empty text has no words and fails the base; repeated rows are judged each; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages kept.
STOP_WORDS = {
    "en": "the be to of and that have with a in is it for on was as are this by from or an at",
    "de": "der die das und ist von zu den mit nicht ein eine des im auf für als auch es an in dem sich",
    "es": "el la de que y en un una los las por con no para su se es del al lo como",
    "fr": "le la les de des et un une en est que qui dans pour pas sur au avec par du ce il elle",
}

#: (name, numerator, denominator, lowest, highest): numerator / denominator must lie in the range.
RULES = [
    ("length", "n_words", "one", 50, 1_000_000),
    ("word_length", "word_chars", "n_words", 1.5, 20.0),
    ("symbols", "n_symbols", "n_words", 0.0, 0.1),
    ("stop_words", "n_stop_words", "n_words", 0.02, 1.0),
    ("dup_lines", "n_dup_lines", "n_lines", 0.0, 0.4),
    ("repeats", "n_repeat_words", "n_words", 0.0, 0.3),
    ("shouting", "n_shout_words", "n_words", 0.0, 0.4),
    ("bullets", "n_bullet_lines", "n_lines", 0.0, 0.9),
    ("ellipses", "n_ellipsis_lines", "n_lines", 0.0, 0.3),
]


def statistics(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id (or another column of docs) and the statistics of the whole text, one row a document."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    has_word = f"[^{SPACE}]"
    out = out.select(
        "doc_id",
        F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)).alias("lines"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    out = out.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_shout_words"),
        F.size(F.filter("lines", lambda x: x.rlike(f"^[{SPACE}]*[-*•‣·]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = lambda i: F.struct(F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)).alias("h"), i.alias("i"))
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    out = out.withColumn("sorted", F.sort_array(F.transform(starts, window))).drop("hashes")
    again = lambda s, k: (F.get("sorted", k + 1)["h"] == s["h"]) | ((k > 0) & (F.get("sorted", F.greatest(k - 1, F.lit(0)))["h"] == s["h"]))
    out = out.withColumn("marked", F.sort_array(F.transform(F.filter("sorted", lambda s, k: F.coalesce(again(s, k), F.lit(False))), lambda s: s["i"]))).drop("sorted")
    spans = F.transform("marked", lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("marked", F.greatest(k - 1, F.lit(0))))))
    out = out.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)).drop("marked")
    # A filter above must not be pushed into the projections, where each use would compute the arrays anew.
    return out.select(F.inline(F.array(F.struct(*out.columns))))


def verdict() -> Column:
    """Whether every rule of the table holds, compared without division."""
    ok = F.lit(True)
    for _, top, bottom, low, high in RULES:
        top = F.col(top).cast("double")
        bottom = F.lit(1.0) if bottom == "one" else F.col(bottom).cast("double")
        ok = ok & (top >= low * bottom) & (top <= high * bottom)
    return ok


def quality(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row of docs(doc_id, text)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs, id_column).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict())


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; each row carries itself, so nothing is joined."""
    return quality(docs.select("text", F.struct("*").alias("whole_row")), "whole_row").where("kept").select("doc_id.*")


def oracle_sql() -> str:
    """The same rules over documents as one DuckDB statement."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    rules = " AND ".join(f"{top} >= {low}::DOUBLE * {bottom if bottom != 'one' else 1} AND {top} <= {high}::DOUBLE * {bottom if bottom != 'one' else 1}" for _, top, bottom, low, high in RULES)
    ws = "\\x20\\x09-\\x0D"
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^{ws}]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{ws}]')) AS lines FROM base),
tri AS (
  SELECT r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
marked AS (SELECT r, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
stats AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[{ws}]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop_words,
    len(list_filter(words, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w)) AS n_shout_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[{ws}]*[-*•‣·]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{ws}]*$'))) AS n_ellipsis_lines
  FROM split LEFT JOIN marked USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed) AND ({rules}) AS kept
FROM judged"""
