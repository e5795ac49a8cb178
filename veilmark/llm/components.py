"""Connected components by alternating large-star and small-star.

Every step is an aggregation with map-side combining followed by an equi-join that adaptive
execution can split, so no neighbourhood is gathered in one task, and nothing but two counters
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id of edges(u, v); component_id is the smallest id reachable.

    Self-loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    edges = stage(edges.select("u", "v").where("u <> v").distinct(), "cc-edges")
    before = _state(edges)
    for _ in range(max_rounds if before[0] else 0):
        last, edges = edges, stage(_small_star(_large_star(edges)), "cc-edges")
        discard(edges.sparkSession, last)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id")))
