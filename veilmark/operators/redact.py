"""Rewriting, residual search and link rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .mapping import keyed


def tasks(detections: DataFrame, mapping: DataFrame) -> DataFrame:
    """Detections with their replacement; a detection without a mapping is skipped."""
    return keyed(detections).join(mapping.select("doc_id", "entity_type", "normalized", "replacement"), ["doc_id", "entity_type", "normalized"])


def rewritten(text: Column, edits: Column) -> Column:
    """The text with array<struct<start, end, replacement>> applied from right to left."""
    last_first = F.reverse(F.array_sort(edits))
    return F.aggregate(last_first, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["replacement"], F.substring(t, e["end"] + 1, F.length(t))))


def redact(paragraphs: DataFrame, detections: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, redacted_text, applied); paragraphs without edits keep their text."""
    edits = tasks(detections, mapping).groupBy("doc_id", "paragraph_index").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    both = paragraphs.join(edits, ["doc_id", "paragraph_index"], "left")
    changed = F.when(F.col("edits").isNotNull(), rewritten(F.col("text"), F.col("edits"))).otherwise(F.col("text"))
    return both.select("doc_id", "paragraph_index", changed.alias("redacted_text"), F.coalesce(F.size("edits"), F.lit(0)).alias("applied"))


def redact_annotated(annotated: DataFrame, mapping: DataFrame) -> DataFrame:
    """As redact, from paragraphs with their spans: only edited paragraphs are joined, and the texts of the others don't move."""
    key = ["doc_id", "paragraph_index"]
    some = F.size("spans") > 0
    edits = tasks(annotated.where(some).select(*key, F.inline("spans")), mapping).groupBy(*key).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    edited = annotated.where(some).select(*key, "text").join(edits, key, "left")
    edited = edited.select(*key, F.when(F.col("edits").isNull(), F.col("text")).otherwise(rewritten(F.col("text"), F.col("edits"))).alias("redacted_text"), F.coalesce(F.size("edits"), F.lit(0)).alias("applied"))
    return edited.unionByName(annotated.where(~F.coalesce(some, F.lit(False))).select(*key, F.col("text").alias("redacted_text"), F.lit(0).alias("applied")))


def rewritten_fields(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """fields(doc_id, ..., instruction) with new_instruction: every original of three characters or more replaced, in the order of creation.

    The replacements are literal and regardless of case; each works on what the one before left.
    """
    wanted = mapping.where(F.length(F.trim("original")) >= 3).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("creation_index", F.trim("original").alias("needle"), F.trim("replacement").alias("value")))).alias("m"))
    both = fields.join(wanted, "doc_id", "left")
    swap = lambda t, m: F.regexp_replace(t, F.concat(F.lit("(?iu)"), quoted(m["needle"])), F.regexp_replace(m["value"], r"([\\$])", r"\\$1"))
    new = F.aggregate(F.coalesce("m", F.expr("cast(array() as array<struct<creation_index:int,needle:string,value:string>>)")), F.col("instruction"), lambda t, m: F.when(F.contains(F.lower(t), F.lower(m["needle"])), swap(t, m)).otherwise(t))
    return both.withColumn("new_instruction", new).drop("m")


def quoted(text: Column) -> Column:
    """A pattern that matches text literally."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def applied_estimate(counts: DataFrame, applied: int | Column) -> DataFrame:
    """counts(entity_type, n) with estimated, each category's share of the replacements applied, rounded half up."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("entity_type", "n", F.when(F.col("total") > 0, F.floor(F.col("n") / F.col("total") * applied + 0.5)).otherwise(0).cast("long").alias("estimated"))


def searchable(entity: Column, original: Column) -> Column:
    """Originals worth a residual search: long enough and not a generic word."""
    least = F.when(entity.isin("PERSON", "ORGANIZATION", "ADDRESS"), 8).otherwise(4)
    return (F.length(original) >= least) & ~F.lower(original).isin(P.GENERIC_WORDS)


def residual(redacted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct originals or keys that still stand as whole words in a paragraph of their document."""
    wanted = mapping.where(searchable(F.col("entity_type"), F.col("original"))).select("doc_id", "entity_type", "normalized", F.explode(F.array_distinct(F.array(F.lower("original"), "normalized"))).alias("needle")).distinct()
    texts = redacted.select("doc_id", F.lower("redacted_text").alias("low"))
    edge = lambda c: F.coalesce(~c.rlike("(?U)\\w"), F.lit(True))
    both = wanted.join(texts, "doc_id").where(F.contains("low", F.col("needle")))
    parts = F.split(F.replace(F.col("low"), F.col("needle"), F.lit("\u0001")), "\u0001")
    whole = F.exists(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda left, i: edge(F.substring(left, -1, 1)) & edge(F.substring(F.get(parts, i + 1), 1, 1))), lambda x: x)
    return both.where(whole).select("doc_id", "entity_type", "normalized").distinct()


def rewrite_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, target, new_target) of relationship targets that hold an original; emails go before persons, then the first seen."""
    wanted = mapping.where(F.col("entity_type").isin("EMAIL_ADDRESS", "PERSON")).select("doc_id", "entity_type", F.col("original").alias("needle"), "replacement", "creation_index")
    both = links.join(wanted, "doc_id").where(F.contains(F.lower("target"), F.lower("needle")))
    order = F.struct(F.when(F.col("entity_type") == "EMAIL_ADDRESS", 0).otherwise(1), "creation_index")
    best = both.groupBy("doc_id", "target").agg(F.min_by(F.struct("needle", "replacement"), order).alias("m"))
    low = F.lower("target")
    swapped = F.expr("concat(substring(target, 1, locate(lower(m.needle), lower(target)) - 1), m.replacement, substring(target, locate(lower(m.needle), lower(target)) + length(m.needle)))")
    return best.select("doc_id", "target", F.when(low.startswith("mailto:"), F.concat(F.lit("mailto:"), F.col("m.replacement"))).otherwise(swapped).alias("new_target"))
