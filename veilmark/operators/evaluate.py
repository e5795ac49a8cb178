"""Scoring of detections against ground truth by exact spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES

KEY = ["doc_id", "entity_type", "paragraph_index", "start", "end"]


def numbered(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY).orderBy(order)))


def exact_matches(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One-to-one matches on the whole key: as many as the smaller side has."""
    return numbered(truth, "gt_id").join(numbered(predicted, "pred_id"), [*KEY, "rn"])


def category_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row a category, zero-filled: counts, precision, recall, F1 and exact-match ratio rounded to 4.

    One grouped pass over both sides: of a whole key as many rows match as the smaller side has.
    """
    dim = truth.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "entity_type string")
    both = truth.select(*KEY, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*KEY, F.lit(0).alias("g"), F.lit(1).alias("p")))
    each = both.groupBy(*KEY).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    sums = each.groupBy("entity_type").agg(F.sum("g").alias("gt"), F.sum("p").alias("pred"), F.sum(F.least("g", "p")).alias("tp"))
    out = dim.join(F.broadcast(sums), "entity_type", "left").fillna(0).withColumn("fp", F.col("pred") - F.col("tp")).withColumn("fn", F.col("gt") - F.col("tp"))
    return with_ratios(out)


def error_maps(metrics: DataFrame) -> DataFrame:
    """One row: fp_by_category and fn_by_category, of categories with any, as maps."""
    some = lambda name: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(name) > 0, F.struct("entity_type", name)))))
    return metrics.agg(some("fp").alias("fp_by_category"), some("fn").alias("fn_by_category"))


def with_ratios(rows: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return rows.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), F.round(ratio(tp, tp + fp + fn), 4).alias("exact_match_ratio"))


def micro_macro(metrics: DataFrame) -> DataFrame:
    """Micro averages of the summed counts, macro averages of the rounded ratios over categories in use."""
    active = metrics.where("gt > 0 or pred > 0")
    macro = active.agg(F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"), F.round(F.avg("f1"), 4).alias("macro_f1"))
    sums = with_ratios(metrics.agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "tp", "fp", "fn")]))
    return sums.crossJoin(F.broadcast(macro))


def unmatched(rows: DataFrame, other: DataFrame, order: str, other_order: str) -> DataFrame:
    return numbered(rows, order).join(numbered(other, other_order).select(*KEY, "rn"), [*KEY, "rn"], "left_anti").drop("rn")


def mismatches(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Unmatched truth with the first unmatched prediction overlapping it; a prediction may serve several rows."""
    left = unmatched(truth, predicted, "gt_id", "pred_id")
    right = unmatched(predicted, truth, "pred_id", "gt_id").select("doc_id", "paragraph_index", F.col("entity_type").alias("p_type"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), "pred_id")
    both = left.join(right, ["doc_id", "paragraph_index"]).where("p_start < end and start < p_end")
    best = both.groupBy("gt_id", "doc_id", "paragraph_index", "entity_type", "start", "end").agg(F.min_by(F.struct("p_type", "p_start", "p_end"), "pred_id").alias("p"))
    return best.select("gt_id", "doc_id", "paragraph_index", "entity_type", F.col("p.p_type").alias("predicted_type"), F.when(F.col("p.p_type") != F.col("entity_type"), "type").otherwise("boundary").alias("kind"))


def false_positives(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Unmatched predictions of paragraphs without a mismatch."""
    return unmatched(predicted, truth, "pred_id", "gt_id").join(mismatches(truth, predicted).select("doc_id", "paragraph_index"), ["doc_id", "paragraph_index"], "left_anti")
