"""Sequence packing as a cutting-stock problem solved by column generation.

Each document becomes ids plus an end id and is cut into pieces: full sequences first, then one
remainder. Remainders count into a histogram of at most capacity / grain lengths (rounded up to the grain).
A linear program over patterns, ways of filling one sequence with histogram lengths, covers the
histogram with the fewest sequences: revised simplex holds a square basis, and knapsack dynamic programming over
the duals prices the next column. Pattern counts are rounded down, the rest is filled greedily, and
the pieces, ranked inside their length, take the patterns' places in order.

Only the histogram and the patterns, both bounded by capacity / grain, reach the driver. Ranks come from counts
by (length, hash bucket), so one very common length spreads over all tasks.

Defined cases: null text counts as empty and packs its end id alone; repeated rows and rows with null doc_id are packed
each; a text of any length is cut into full sequences and one remainder; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, arrow_map, resident, stage

_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"


class WordTokens:
    """Ids of whole texts as the tokenizers library gives them, with the words remembered.

    The vocabulary splits a normalised text into words that encode independently, so over plain Latin-1
    texts a word goes through the library until it is remembered; any other text goes through it whole.
    """

    plain = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xff]*").fullmatch
    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would keep memory
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.whole: Tokenizer | None = None
        #: The model for words that are cut and lower-cased already.
        self.cut = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.cut.get_added_tokens_decoder().values())
        self.cut.no_truncation()
        self.cut.no_padding()
        self.cut.normalizer = normalizers.Sequence([])
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.cut.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Remembered(64_000_000)

    @property
    def library(self):
        """The vocabulary with its own normalisation and splitting, loaded where a text needs them."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.no_truncation()
            self.whole.no_padding()
        return self.whole

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: many words go through the library as one text, cut again behind the ids that end a word."""
        lines = [" ".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        ids = np.concatenate([np.asarray(e.ids, "<u4") for e in self.cut.encode_batch_fast(lines, add_special_tokens=False)])
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(words) or cuts[-1] != 4 * len(ids):
            return self._ask(words)  # a vocabulary whose words don't end in a mark
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        at, get = 0, self.words.known.get
        while at < len(texts):
            found, gaps, size = {}, [], 0
            while at < len(texts) and size < 1_000_000:
                text = texts[at] or ""
                if self.plain(text) and not any(s in text for s in self.special):
                    words = self.split(text.lower())
                    found[at] = ids = list(map(get, words))  # one look-up a word: the costly part
                    k = -1
                    for _ in range(ids.count(None)):
                        k = ids.index(None, k + 1)
                        gaps.append((ids, k, words[k]))
                else:
                    out[at] = self._ask([text])[0]
                size += len(text)
                at += 1
            new = list({w for _, _, w in gaps})
            learnt = dict(zip(new, self._ask_words(new))) if new else {}
            for ids, k, w in gaps:
                ids[k] = learnt[w]
            for k, ids in found.items():
                out[k] = b"".join(ids)
            self.words.keep(learnt)
        return out


def _loaded(path: str) -> WordTokens:
    return resident(("packing", path), lambda: WordTokens(path))


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    end = struct.pack("<I", end_id)

    def cut(cols: dict) -> dict:
        out: dict = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, ids in zip(cols["doc_id"], _loaded(path)(cols["text"])):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[start * 4 : (start + capacity) * 4]
                for c, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n)):
                    out[c].append(v)
        return out

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), cut, ", ".join(f"{c} long" for c in names), pa.schema([(c, pa.int64()) for c in names]))


def _price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            values = best[c - sizes[:k]] + duals[:k]
            j = int(values.argmax())
            if values[j] > best[c] + 1e-12:
                best[c], took[c] = values[j], j
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), pattern


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchanges, free of threaded library calls in the driver."""
    m = len(matrix)
    work = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        others = np.flatnonzero(work[:, k])
        others = others[others != k]
        work[others] -= work[others, k : k + 1] * work[k]
    return work[:, m:]


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, their fractional counts) that cover the demand with the fewest sequences.

    Stops when no pattern prices out, when the Lagrangian bound proves the gap or half a sequence, or after a number of
    turns that grows with the histogram: any basis holds valid patterns, and the greedy rest fills what it leaves.
    The demand is perturbed by less than a thousandth of a piece, which keeps degenerate bases from cycling.
    """
    m = len(sizes)
    demand = demand + 1e-3 * (np.arange(m) * 0.6180339887 % 1)
    basis = np.diag(capacity // sizes).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = demand / (capacity // sizes)
    for turn in range(4 * m + 50):
        duals = cost @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[low] = -1.0
        else:
            value, pattern = _price(sizes, np.maximum(duals, 0), capacity)
            if value <= 1 + 1e-9 or cost @ x * (1 - 1 / value) <= max(0.5, gap * (cost @ x)):
                break
            column, price = pattern.astype(float), 1.0
        step = inverse @ column
        ratio = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
        if turn % 200 == 199:
            inverse = _inverted(basis)
            x = np.maximum(inverse @ demand, 0)
    real = cost > 0
    return basis[:, real].astype(np.int64), x[real]


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first rank, ranks, pieces a sequence, first sequence) that seat every piece of the histogram."""
    sizes = np.array(sorted(s for s in histogram if s < capacity), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    seated = dict.fromkeys(histogram, 0)
    plan, sequence = [], 0

    def seat(pattern: np.ndarray, copies: int) -> None:
        nonlocal sequence
        for k in np.flatnonzero(pattern):
            size, each = int(sizes[k]), int(pattern[k])
            plan.append((size, seated[size], each * copies, each, sequence))
            seated[size] += each * copies
        left[:] -= pattern * copies
        sequence += copies

    if len(sizes):
        patterns, counts = linear_program(sizes, left.astype(float), capacity)
        for k in np.argsort(-counts, kind="stable"):
            pattern = patterns[:, k]
            used = pattern > 0
            copies = min(int(counts[k] + 1e-2), int((left[used] // pattern[used]).min()) if used.any() else 0)
            if copies > 0:
                seat(pattern, copies)
        while left.any():
            pattern, room = np.zeros(len(sizes), np.int64), capacity
            for k in np.flatnonzero(left)[::-1]:
                pattern[k] = min(left[k], room // sizes[k])
                room -= pattern[k] * sizes[k]
            used = pattern > 0
            seat(pattern, int((left[used] // pattern[used]).min()))
    if histogram.get(capacity):
        plan.append((capacity, 0, histogram[capacity], 1, sequence))
    return plan


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, grain: int = 8) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece.

    docs has doc_id and text; a sequence's pieces lie gapless from offset 0 and hold at most capacity ids.
    """
    spark = docs.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces_of(docs, path, capacity, end_id)
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    pieces = stage(pieces, "pack-pieces")
    counts = stage(pieces.groupBy("size", "bucket").count(), "pack-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    plan = sorted(plan_sequences(histogram, capacity // grain))
    lows = np.array([p[0] << 44 | p[1] for p in plan], np.int64)
    each = np.array([p[3] for p in plan], np.int64)
    first = np.array([p[4] for p in plan], np.int64)

    # Pieces of a size before a bucket: first by groups of 32 buckets, then inside the group, so no task reads all buckets of a size.
    counts = counts.withColumn("part", F.floor(F.col("bucket") / 32).cast("int"))
    above = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("size", "part").agg(F.sum("count").alias("n")).select("size", "part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    before = Window.partitionBy("size", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(parts, ["size", "part"]).select("size", "bucket", (F.col("above") + F.coalesce(F.sum("count").over(before), F.lit(0))).alias("before"))
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = pieces.withColumn("n", F.row_number().over(inside)).join(offsets, ["size", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("n") - 1).alias("rank"))

    def place(batches):
        for b in batches:
            code = b.column(5).to_numpy(zero_copy_only=False).astype(np.int64) << 44 | b.column(6).to_numpy(zero_copy_only=False)
            k = np.searchsorted(lows, code, "right") - 1
            sequence = first[k] + (code - lows[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), b.column(5)], names=[*names, "sequence_id", "size"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.mapInArrow(place, ", ".join(f"{c} long" for c in [*names, "sequence_id"]) + ", size int")
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).select(*names, "sequence_id", "offset")
