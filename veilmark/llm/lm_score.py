"""Cross-entropy difference scoring with matched target and background bigram models.

Both models share the whole vocabulary of the corpus, one smoothing and one layout, and are counted in one pass: the
background over all documents, the target over those marked as in-domain. A document's score is the mean over its
tokens of target loss minus background loss, so lower means closer to the target.

No word and no bigram is left out or merged: each is told apart by a 64-bit hash, and what is gathered grows with the
corpus. Documents are taken in parts of many tokens; a part counts its words and bigrams and sends them, sorted and cut
into key ranges, to one group a range, which sums all parts and answers each part for its own keys. So no table of the
model stands in one place, a very common word costs one entry a part, and the ranges grow in number with the text.
Keys travel as the bytes of their differences, place by place, which compress.

With leave_own_out a trained document is scored by the models without its own counts, so it does not vouch for itself.

Defined cases: null text counts as empty; without words the losses are null and score is 0; without
target documents the target model is uniform; repeated rows count each; words the corpus lacks have count 0; there is no order among
words, so no ties; texts of any length are read whole; a null doc_id is scored and is no target; columns other than doc_id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stage
from .minhash import word_hashes

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text a key range stands for.
RANGE_BYTES = 16_000_000


def word_codes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (runs without white space, A-Z lower-cased)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return word_hashes(words)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _pack_keys(x: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the bytes of their differences by place, since the high ones are mostly zero."""
    return _pack(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def _unpack_keys(data: bytes, n: int) -> np.ndarray:
    places = _unpack(data, 8 * n, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(places.T).view(np.uint64).ravel(), dtype=np.uint64)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.empty(0, kind)


@dataclass
class Models:
    """The trained documents in parts, whose counts are summed by key range when documents are scored."""

    docs: DataFrame
    parts: DataFrame
    slots: int
    weights: tuple[float, float, float] = (0.5, 0.4, 0.1)

    @property
    def unigrams(self) -> np.ndarray:
        """Background and target count of each word in the order of their codes; gathered, so for small corpora only."""
        codes, n, t = [np.empty(0, np.uint64)], [np.empty(0)], [np.empty(0)]
        for row in self.parts.toLocalIterator():
            part = _Part(row.asDict())
            codes.append(part.codes)
            n.append(np.bincount(part.words, minlength=len(part.codes)))
            t.append(np.bincount(part.words[part.target], minlength=len(part.codes)))
        found, at = np.unique(np.concatenate(codes), return_inverse=True)
        return np.column_stack([np.bincount(at, np.concatenate(x), len(found)) for x in (n, t)])


class _Part:
    """One row of parts, read back: per token its place in codes, whether it is target and whether a word stands before it."""

    def __init__(self, row: dict):
        self.doc_id, self.lengths = row["doc_id"], np.array(row["length"], np.int64)
        self.codes = _unpack_keys(row["codes"], row["n_codes"])
        self.words = _unpack(row["words"], int(self.lengths.sum()), np.int32)
        self.target = np.repeat(np.array(row["target"], bool), self.lengths)
        self.starts = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        self.follows = np.ones(len(self.words), bool)
        self.follows[self.starts] = False

    def pairs(self) -> np.ndarray:
        """Bigram keys of the tokens that follow another."""
        codes = self.codes[self.words]
        return mix64(codes[:-1] * _STEP + codes[1:])[self.follows[1:]]


_PARTS = "part long, doc_id array<long>, length array<int>, target array<int>, n_codes int, codes binary, words binary"
_PARTS_ARROW = pa.schema([("part", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("length", pa.list_(pa.int32())), ("target", pa.list_(pa.int32())), ("n_codes", pa.int32()), ("codes", pa.binary()), ("words", pa.binary())])


def _parts(docs: DataFrame, slots: int) -> DataFrame:
    """docs(doc_id, text, target) as staged rows of many documents each."""

    def row(number: int, ids: list, codes: list, target: list) -> pa.RecordBatch:
        found, words = np.unique(np.concatenate(codes), return_inverse=True)
        cells = [number, ids, [len(c) for c in codes], target, len(found), _pack_keys(found), _pack(words.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _PARTS_ARROW)], schema=_PARTS_ARROW)

    def run(batches):
        number, size, held = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, text, target in zip(*(part.column(i).to_pylist() for i in range(3))):
                    codes = word_codes(text)
                    for column, value in zip(held, (doc, codes, target)):
                        column.append(value)
                    size += len(codes) + 1
                    if size >= slots:
                        yield row(number, *held)
                        number, size, held = number + 1, 0, ([], [], [])
        if held[0]:
            yield row(number, *held)

    return stage(docs.select("doc_id", "text", "target").mapInArrow(run, _PARTS), "lm-parts")


_POSTS = "bucket int, part long, asks boolean, size int, keys binary, n binary, t binary"


def _posts(parts: DataFrame, buckets: int, counts: bool, asks: bool) -> DataFrame:
    """The words (buckets from 0) and bigrams (from buckets) of each part by key range, with their counts unless counts is false."""

    def run(batches):
        edges = np.array([-(-b * (1 << 32) // buckets) << 32 for b in range(buckets)], np.uint64)
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                part = _Part(row)
                pairs = part.pairs()
                found, n = np.unique(pairs, return_counts=True)
                inside, m = np.unique(pairs[part.target[part.follows]], return_counts=True)
                t = np.zeros(len(found), np.int64)
                t[np.searchsorted(found, inside)] = m
                size = len(part.codes)
                words = part.codes, np.bincount(part.words, minlength=size), np.bincount(part.words[part.target], minlength=size)
                for first, (keys, n, t) in ((0, words), (buckets, (found, n, t))):
                    cuts = [*np.searchsorted(keys, edges).tolist(), len(keys)]
                    spans = [(first + b, slice(i, j)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
                    n, t = (x.astype(np.int32) * counts for x in (n, t))
                    sizes = [s.stop - s.start for _, s in spans]
                    cells = [[b for b, _ in spans], [row["part"]] * len(spans), [asks] * len(spans), sizes, [_pack_keys(keys[s]) for _, s in spans], *([_pack(x[s]) for _, s in spans] for x in (n, t))]
                    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["bucket", "part", "asks", "size", "keys", "n", "t"])

    return parts.mapInArrow(run, _POSTS)


_COUNTS = "part long, bucket int, size long, n binary, t binary, all_n long, all_t long"
_COUNTS_ARROW = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("size", pa.int64()), ("n", pa.binary()), ("t", pa.binary()), ("all_n", pa.int64()), ("all_t", pa.int64())])


def _range_counts(table: pa.Table) -> pa.Table:
    """Corpus counts of a key range for each part that asks, and a row without part for the range itself."""
    rows = table.to_pydict()
    keys = [_unpack_keys(x, n) for x, n in zip(rows["keys"], rows["size"])]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    n, t = (np.bincount(at, np.concatenate([_unpack(x, k, np.int32) for x, k in zip(rows[c], rows["size"])]), len(found)).astype(np.int64) for c in ("n", "t"))
    out, start = [(None, rows["bucket"][0], int(np.count_nonzero(n)), None, None, int(n.sum()), int(t.sum()))], 0
    for part, asks, own in zip(rows["part"], rows["asks"], keys):
        mine = at[start : start + len(own)]
        start += len(own)
        if asks:
            out.append((part, rows["bucket"][0], len(own), _pack(n[mine]), _pack(t[mine]), None, None))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _COUNTS_ARROW)], schema=_COUNTS_ARROW)


def train(docs: DataFrame, target_ids: DataFrame, slots: int = 1 << 20) -> Models:
    """Models from all of docs(doc_id, text); target_ids(doc_id) marks the target documents.

    slots is how many tokens a part holds before its counts leave the task; it bounds memory, not the models.
    """
    target = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(1))
    small = stage(target, "lm-target")
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(small) if small.count() <= 2_000_000 else small, "doc_id", "left")
    return Models(docs, _parts(marked.select("doc_id", "text", F.coalesce("target", F.lit(0)).alias("target")), slots), slots)


def _own(document: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each token's key stands in the token's own document."""
    _, at, n = np.unique(document * (int(keys.max(initial=0)) + 1) + keys, return_inverse=True, return_counts=True)
    return n[at]


def score(docs: DataFrame, models: Models, leave_own_out: bool = False) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of docs.

    leave_own_out holds for the documents the models were trained on, given as the same DataFrame.
    """
    same = docs is models.docs
    apart = leave_own_out and same
    asking = models.parts if same else _parts(docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).alias("target")), models.slots)
    buckets = max(32, -(-(models.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    posts = _posts(models.parts, buckets, True, same)
    if not same:
        posts = posts.unionByName(_posts(asking, buckets, False, True))
    counts = stage(posts.groupBy("bucket").applyInArrow(_range_counts, _COUNTS), "lm-counts")
    size, *sums = counts.where((F.col("part").isNull()) & (F.col("bucket") < buckets)).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "all_n", "all_t")]).first()
    high, middle, low = models.weights

    def rows(parts: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict = {"doc_id": [], "n_tokens": [], "target_loss": [], "background_loss": [], "score": []}
        found = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        for row in parts.to_pylist():
            part = _Part(row)
            at = np.unique(part.pairs(), return_inverse=True)[1]
            before = np.flatnonzero(part.follows) - 1
            document = np.repeat(np.arange(len(part.lengths)), part.lengths)
            own = [_own(document, part.words), _own(document[part.follows], at), part.lengths[document]] if apart else [0, 0, np.zeros(len(document))]
            losses = []
            for name, total in (("t", sums[1]), ("n", sums[0])):
                # What each token's own document has counted of its word, its bigram and all words.
                in_word, in_pair, in_all = own if name == "n" or not apart else (own[0] * part.target, own[1] * part.target[part.follows], own[2] * part.target)
                uni, bi = (np.concatenate([np.empty(0, np.int64), *(_unpack(r[name], r["size"], np.int64) for r in found if (r["bucket"] >= buckets) == kind)]) for kind in (False, True))
                words = uni[part.words] - in_word
                p = middle * words / np.maximum(1, total - in_all) + low / (size + 1)
                context = words[before]
                p[part.follows] += high * np.minimum(1, np.divide(bi[at] - in_pair, context, out=np.zeros(len(at)), where=context > 0))
                mean = np.full(len(part.lengths), np.nan)
                if len(p):
                    mean[part.lengths > 0] = np.add.reduceat(-np.log(p), part.starts) / part.lengths[part.lengths > 0]
                losses.append(mean)
            out["doc_id"] += part.doc_id
            out["n_tokens"] += part.lengths.tolist()
            for name, x in (("target_loss", losses[0]), ("background_loss", losses[1])):
                out[name] += [v if k else None for v, k in zip(x.tolist(), part.lengths.tolist())]
            out["score"] += np.where(part.lengths > 0, losses[0] - losses[1], 0.0).tolist()
        return pa.table(out, schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])
    answers = counts.where("part is not null").select("part", "bucket", "size", "n", "t")
    return asking.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(rows, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
