"""Near-duplicate embeddings: an exact metric range join over pivot cells.

Vectors on the unit sphere link when their cosine reaches a threshold, i.e. when their chord
distance is at most r. Equal vectors collapse to one class with a weight first. Pivots, a bounded
hash sample, partition the classes by the nearest pivot p. A class also visits the cell of pivot q as a guest when
a home of q may lie within r: by the triangle inequality that needs d(x,q) - d(x,p) <= 2r, and in
this space the distance to the bisector, (d(x,q)^2 - d(x,p)^2) / 2d(p,q), at most r, which is sharper. So every link
of a home is found in its own cell and the cells join independently.

A cell's homes are dealt in blocks of bounded size; a task holds one block and streams the cell's classes past it,
so memory doesn't grow with a cell. A float32 product proposes pairs, double precision decides. Per home
the task returns the links' total weight, and a spanning forest of the block's links, each edge as soon as it is met, never the pairs.
The pivots grow with the classes up to MAX_PIVOTS or PIVOT_BYTES; beyond MAX_PIVOTS * cell_size classes (134 million) the cells
grow, and with them the comparisons, quadratically. On vectors without structure in many dimensions guests reach most cells, as in any
exact join.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component, and a row
with null vec_id, links with nothing; vectors of different lengths don't link; repeated rows count as vectors of
their own; columns other than vec_id and embedding are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small, stage
from .components import connected_components

MAX_PIVOTS, PIVOT_BYTES = 32_768, 64_000_000


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the components as little-endian doubles, null where the row links with nothing."""

    def rows(batches):
        for batch in batches:
            keep = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = x.values if x.is_valid else None
                v = None
                if doc is not None and a is not None and len(a) and not a.null_count:
                    n = np.asarray(a, "<f8") + 0.0
                    if np.isfinite(n).all() and n.any():
                        v = n.tobytes()
                keep.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(rows, "vec_id long, v binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class _Cells:
    """Nearest pivots and guest cells; pivots by vector length, lengths without one have a single cell."""

    def __init__(self, raw: list[bytes], radius: float):
        self.radius = radius
        self.pivots: dict[int, np.ndarray] = {}
        for size in {len(x) for x in raw}:
            self.pivots[size] = np.unique(_unit([x for x in raw if len(x) == size]), axis=0)

    def visits(self, raw: list[bytes]) -> Iterator[tuple[int, str, bool]]:
        """(row, cell, is home) of every cell that each row is in."""
        for size in {len(x) for x in raw}:
            same = np.flatnonzero([len(x) == size for x in raw])
            if size not in self.pivots:
                yield from ((int(k), f"{size}/0", True) for k in same)
                continue
            pivots = self.pivots[size]
            step = max(1, 2_000_000 // len(pivots))  # rows at once, so that their distances to all pivots take 16 MB
            for rows in (same[k : k + step] for k in range(0, len(same), step)):
                cosines = _unit([raw[k] for k in rows]) @ pivots.T
                home = cosines.argmax(axis=1)
                best = cosines[np.arange(len(rows)), home][:, None]
                far = np.sqrt(np.maximum(0, 2 - 2 * cosines)) - np.sqrt(np.maximum(0, 2 - 2 * best)) > 2 * self.radius + 1e-9
                gaps = np.sqrt(np.maximum(0, 2 - 2 * pivots[home] @ pivots.T))
                inside = ~(far | (best - cosines > self.radius * gaps + 1e-9))
                inside[np.arange(len(rows)), home] = True
                for k, c in zip(*np.nonzero(inside)):
                    yield int(rows[k]), f"{size}/{c}", bool(home[k] == c)


class _Block:
    """Homes of one block, while the cell's classes stream past."""

    def __init__(self, ids: list[int], weights: list[int], raw: list[bytes], cosine: float):
        order = np.argsort(ids)
        self.ids = np.array(ids, np.int64)[order]
        self.unit = _unit([raw[k] for k in order])
        self.single = self.unit.astype(np.float32)
        self.cosine = cosine
        self.links = np.array(weights, np.int64)[order] - 1
        self.label = np.arange(len(ids))

    def meet(self, ids: np.ndarray, weights: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Counts the links of some of the cell's classes; an edge for each of them that has one."""
        unit = _unit(raw)
        close = self.single @ unit.astype(np.float32).T >= np.float32(self.cosine - 1e-4)
        h, g = np.nonzero(close)
        if not len(h):
            return None
        keep = self.ids[h] != ids[g]
        h, g = h[keep], g[keep]
        sure = np.concatenate([np.einsum("ij,ij->i", self.unit[h[k : k + 200_000]], unit[g[k : k + 200_000]]) >= self.cosine for k in range(0, len(h), 200_000)] or [np.empty(0, bool)])
        h, g = h[sure], g[sure]
        if not len(h):
            return None
        np.add.at(self.links, h, weights[g])
        while True:
            low = np.full(len(ids), len(self.ids))
            np.minimum.at(low, g, self.label[h])
            root = np.arange(len(self.ids))
            np.minimum.at(root, self.label[h], low[g])
            if (root == np.arange(len(root))).all():
                break
            self.label = root[self.label]
        met = np.unique(g)
        return ids[met], self.ids[low[met]]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, id, value): kind 0 with the links of a home, kind 1 with an edge between homes."""
        yield np.zeros(len(self.ids), np.int32), self.ids, self.links
        yield np.ones(len(self.ids), np.int32), self.ids, self.ids[self.label]


def _join_cells(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, block = None, ([], [], []), None

        def edges(found):
            for kind, a, b in found:
                away = (a != b) | (kind == 0)
                yield pa.RecordBatch.from_arrays([pa.array(kind[away]), pa.array(a[away]), pa.array(b[away])], names=["kind", "id", "value"])

        def flush():
            yield from edges(block.rows() if block else ())

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                cells, role, ids, weights, raw = (batch.slice(at, 2048).column(i).to_pylist() for i in range(5))
                lo = 0
                while lo < len(cells):
                    if cells[lo] != now:
                        if block is None and homes[0]:
                            block = _Block(*homes, cosine)
                        yield from flush()
                        now, homes, block = cells[lo], ([], [], []), None
                    hi = lo + 1
                    while hi < len(cells) and cells[hi] == now and role[hi] == role[lo]:
                        hi += 1
                    if role[lo] == 0:
                        for kept, new in zip(homes, (ids, weights, raw)):
                            kept += new[lo:hi]
                    else:
                        if block is None and homes[0]:
                            block = _Block(*homes, cosine)
                        if block is not None and (met := block.meet(np.array(ids[lo:hi], np.int64), np.array(weights[lo:hi], np.int64), raw[lo:hi])):
                            yield from edges([(np.ones(len(met[0]), np.int32), *met)])
                    lo = hi
        yield from flush()

    return run


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.95, cell_size: int = 4096, block_size: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding)."""
    radius = sqrt(max(0.0, 2 - 2 * cosine))
    digest = F.substring(F.unhex(F.sha2("v", 256)), 1, 16)  # what vectors are grouped and joined by
    prepared = stage(_prepared(vectors).withColumn("fp", digest), "vec-rows")
    classes = stage(prepared.where("v is not null").groupBy("fp").agg(F.first("v").alias("v"), F.min("vec_id").alias("id"), F.count("*").alias("w")), "vec-classes")
    count, longest = classes.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    pivots = min(MAX_PIVOTS, PIVOT_BYTES // max(8, longest or 0), max(8, ceil(count / cell_size)))
    drawn = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < min(1 << 30, ceil((1 << 30) * (2 * pivots + 64) / max(1, count))))
    cells = _Cells([bytes(r["v"]) for r in drawn.orderBy("fp").limit(pivots).collect()], radius)

    def visit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = list(cells.visits(part.column(0).to_pylist()))
                rows, names, home = zip(*found) if found else ((), (), ())
                part = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(names, pa.string()), pa.array(home, pa.bool_())], names=["v", "id", "w", "cell", "home"])

    spread = stage(classes.select("v", "id", "w").mapInArrow(visit, "v binary, id long, w long, cell string, home boolean"), "vec-cells")
    blocks = stage(spread.where("home").groupBy("cell").agg(F.ceil(F.count("*") / block_size).cast("int").alias("blocks")), "vec-blocks")
    dealt = spread.join(small(blocks), "cell")
    own = dealt.where("home").select(F.concat_ws("/", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("string")).alias("cell"), F.lit(0).alias("role"), "id", "w", "v")
    every = dealt.select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), "cell", "id", "w", "v").select(F.concat_ws("/", "cell", F.col("k").cast("string")).alias("cell"), F.lit(1).alias("role"), "id", "w", "v")
    joined = own.unionByName(every).repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(_join_cells(cosine), "kind int, id long, value long")
    joined = stage(joined, "vec-joined")
    discard(vectors.sparkSession, spread, blocks)
    parts = connected_components(joined.where("kind = 1").select(F.col("id").alias("u"), F.col("value").alias("v")))
    links = joined.where("kind = 0").select("id", F.col("value").alias("n_links"))
    known = classes.select("fp", "id").join(links, "id").join(parts, "id", "left").select("fp", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    rows = prepared.select("vec_id", "fp").join(known, "fp", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
