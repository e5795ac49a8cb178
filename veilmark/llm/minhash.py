"""MinHash near-duplicate detection on word shingles.

Words are runs of non-white-space bytes after lower-casing A-Z; a document's set holds its distinct
`width`-word shingles as 64-bit hashes. Documents with equal sets collapse to one representative
before any banding, so a group of exact copies costs one row however large it is. Representatives
sharing a band of `rows` minima are candidates. A bucket never emits all its pairs: in each of a few rounds it
pairs its members with one head; the pairs pass a size bound and the signature, and only then are the
full sets compared; links go to connected components. Members of a bucket that still lie in several components
after these rounds (variants just short of the similarity, texts that share a passage) go through an exact prefix-filter join
over their shingles, so no pair of a bucket is lost: each is compared, connected, or proven below the similarity. That join moves
ids, sizes and one bitmap a document, never the sets; a shingle in the prefixes of very many documents is dealt in shares; what size,
position and bitmap leave of the pairs is compared on the full sets.

With 32 bands of 4 rows a pair of similarity 0.75 shares no band with probability below 6e-6, and one in
about 10,000 such pairs falls under the signature cut of four standard deviations.

Defined cases: null or empty text, or text without words, has an empty set and links with nothing;
a null doc_id links with nothing; repeated rows of one doc_id are one node of the graph, linked by any of its texts; texts of any length are
read whole; columns other than doc_id and text are ignored; an empty table gives no rows. More than 60 rounds of components raise an error
(their number grows with the logarithm of a component's size).
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, mix64, resident, semi_by_id, small, stage
from .components import connected_components

SEED = 20240229
#: Longs of a set's bitmap, and how many documents' places of one shingle meet in one share of the prefix join.
BITMAP, SHARE = 16, 512


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(resident("words", _WordHashes).__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text; fewer words than width make one shingle of them all."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    span = min(n, width)
    acc = np.zeros(n - span + 1, np.uint64)
    for k in range(span):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : n - span + 1 + k]
    return np.unique(mix64(acc + np.uint64(span)))


class Signer:
    """Universal-hash minima of a shingle set, as band keys and one byte per minimum."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.Generator(np.random.PCG64(SEED))
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)[:, None]

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            part = self.a * shingles[None, at : at + 1024]
            part += self.b
            np.minimum(low, part.min(axis=1), out=low)
        low >>= np.uint64(32)
        keys = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + low[r :: self.rows])
        return keys.view(np.int64), (low & np.uint64(0xFF)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, fp, bands, sketch); the last three are null for an empty set."""

    def sign(cols: dict) -> dict:
        signer = _signer(bands, rows)
        out: dict = {"doc_id": cols["doc_id"], "n_shingles": [], "fp": [], "bands": [], "sketch": []}
        for text in cols["text"]:
            s = shingle_set(text, width)
            out["n_shingles"].append(len(s))
            if len(s):
                keys, sketch = signer(s)
                out["fp"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                out["bands"].append(keys)
                out["sketch"].append(sketch)
            else:
                for c in ("fp", "bands", "sketch"):
                    out[c].append(None)
        return out

    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), sign, "doc_id long, n_shingles long, fp binary, bands array<long>, sketch binary", arrow)


_SIGNERS: dict = {}


def _signer(bands: int, rows: int) -> Signer:
    if (bands, rows) not in _SIGNERS:
        _SIGNERS[bands, rows] = Signer(bands, rows)
    return _SIGNERS[bands, rows]


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def sets(cols: dict) -> dict:
        return {"id": cols["doc_id"], "s": [shingle_set(t, width).view(np.int64) for t in cols["text"]]}

    return arrow_map(docs, sets, "id long, s array<long>", pa.schema([("id", pa.int64()), ("s", pa.list_(pa.int64()))]))


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(id, f, bits) of sets(id, f, s): bit k is the parity of the shingles that fall on it, so two bitmaps differ in at most as many bits as the sets in shingles."""

    def run(batches):
        for batch in batches:
            bits = []
            for x in batch.column(2):
                at = (x.values.to_numpy().view(np.uint64) >> np.uint64(7)) & np.uint64(64 * BITMAP - 1)
                bits.append(np.packbits((np.bincount(at.astype(np.int64), minlength=64 * BITMAP) & 1).astype(np.uint8)).view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.list_(pa.int64()))], names=["id", "f", "bits"])

    return sets.mapInArrow(run, "id long, f long, bits array<long>")


def _alike(pairs: DataFrame, sketches: DataFrame, cut: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least the share cut of their minima."""
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = both.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = both.where("100 * least(na, nb) >= 75 * greatest(na, nb)").select("a", "b", "sa", "sb")

    def agree(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array((sa == sb).mean(axis=1) >= cut)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(agree, "a long, b long").distinct()


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, s) of the documents of ids(id), whose texts are read again; repeated rows of a set give one."""
    ids = stage(ids.select(F.col("id").alias("doc_id")).distinct(), "near-ids")
    sets = stage(_full_sets(semi_by_id(docs, ids, "doc_id"), width), "near-sets")
    discard(docs.sparkSession, ids)
    again = stage(sets.groupBy("id", F.xxhash64("s").alias("f")).agg(F.count("*").alias("c")).where("c > 1").select("id").distinct(), "near-again")
    if not again.isEmpty():
        rows, few = sets, small(again)
        sets = stage(rows.join(few, "id", "left_anti").unionByName(rows.join(few, "id", "left_semi").distinct()), "near-sets")
        discard(docs.sparkSession, rows)
    discard(docs.sparkSession, again)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v): pairs whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    inter = F.size(F.array_intersect("x", "y"))
    both = both.where(100 * inter >= percent * (F.size("x") + F.size("y") - inter))
    return stage(both.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "near-links")


def _prefix_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links (u, v) of rest(id, c) across components: candidates by prefixes and bitmaps, decided on the full sets.

    Shingles are ordered by frequency among these documents, rarest first. Of two linked documents, the larger
    shares with its prefix one of the smaller's; shingles of one document or one component alone give no pair. So
    variants of one text that fall short of the similarity, which differ by shingles of their own, don't meet. A pair that
    meets is a candidate if the shared shingles left before and after the meeting, and the bits in which the bitmaps
    differ, still allow the similarity.
    """
    t = percent / 100
    rows = sets.join(small(rest), "id").select("id", F.xxhash64("s").alias("f"), "c", F.size("s").alias("n"), "s")  # f tells sets of one id apart
    shared = stage(rows.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "near-shared")
    tokens = rows.select("id", "f", "c", "n", "s").repartition("id", "f").select("id", "f", "c", "n", F.explode("s").alias("t"))
    own = tokens.join(small(shared), "t").groupBy("id", "f", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    alone = F.col("n") - F.size("ts")  # shingles of this document only come first in the order and are never shared
    length = lambda least: F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1 - alone)
    own = own.select("id", "f", "c", "n", F.size("ts").alias("m"), F.transform(F.slice("ts", F.lit(1), length(t)), lambda x: x["t"]).alias("prefix"), length(2 * t / (1 + t)).alias("index")).where(F.size("prefix") > 0)
    own = stage(own.join(_bitmaps(rows.select("id", "f", "s")), ["id", "f"]), "near-own")
    posts = own.select("id", "c", "n", "m", "index", "bits", F.posexplode("prefix").alias("k", "t"))
    mixed = posts.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.col("k") < F.col("index")).alias("indexed"), F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    mixed = stage(mixed.where("lo < hi and indexed").select("t", "shares"), "near-mixed")
    names = ["id", "c", "n", "m", "k"]
    posts = posts.join(small(mixed), "t").select("t", "shares", "index", *names, *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITMAP)])
    names += [f"b{i}" for i in range(BITMAP)]
    x = posts.select(F.col("t").alias("x_t"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("x_share"), *[F.col(c).alias(f"x_{c}") for c in names])
    y = posts.where("k < index").select(F.col("t").alias("y_t"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("y_share"), *[F.col(c).alias(f"y_{c}") for c in names])
    need = F.ceil((F.col("x_n") + F.col("y_n")) * (t / (1 + t)) - 1e-9)
    reach = F.least("x_k", "y_k") + F.least(F.col("x_m") - F.col("x_k"), F.col("y_m") - F.col("y_k"))
    fits = (F.col("x_c") != F.col("y_c")) & (F.col("y_n") <= F.col("x_n")) & (100 * F.col("y_n") >= percent * F.col("x_n")) & (reach >= need)
    differ = sum((F.bit_count(F.col(f"x_b{i}").bitwiseXOR(F.col(f"y_b{i}"))) for i in range(1, BITMAP)), F.bit_count(F.col("x_b0").bitwiseXOR(F.col("y_b0"))))
    close = F.col("x_n") + F.col("y_n") - differ >= 2 * need
    pairs = x.join(y, (F.col("x_t") == F.col("y_t")) & (F.col("x_share") == F.col("y_share")) & F.when(fits, close).otherwise(F.lit(False)))
    pairs = stage(pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "near-pairs")
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    links = _verified(pairs, semi_by_id(sets, ids, "id"), percent)
    discard(sets.sparkSession, shared, own, mixed, pairs, ids)
    return links


def _heads(rows: DataFrame) -> DataFrame:
    """(key, head, hc) of the buckets whose members lie in several components: one member by hash."""
    order = F.xxhash64("id", "key")
    best = rows.groupBy("key").agg(F.min_by("id", order).alias("head"), F.min_by("c", order).alias("hc"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return best.where("lo < hi").select("key", "head", "hc")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Documents link when 100 * |intersection| >= percent * |union| of their full sets;
    component_id is the smallest doc_id reachable over links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    similarity = percent / 100
    cut = similarity - 4 * sqrt(similarity * (1 - similarity) / (bands * rows))
    signed = stage(signatures(docs, width, bands, rows), "near-sign")
    full = signed.where("fp is not null and doc_id is not null")
    groups = stage(full.groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r")).select("fp", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), "r.bands", "r.sketch"), "near-groups")
    sketches = groups.select("id", "n", "sketch")

    members = groups.select("id", F.explode("bands").alias("key"))
    shared = stage(members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-keys")
    active = stage(semi_by_id(members, shared, "key"), "near-buckets")
    discard(docs.sparkSession, shared)
    links, part = [], None
    for turn in range(rounds + 1):
        rows_now = active.withColumn("c", F.col("id")) if part is None else active.join(part, active.id == part.node, "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
        heads = stage(_heads(rows_now), "near-heads")
        open_rows = stage(rows_now.join(small(heads), "key"), "near-open")
        discard(docs.sparkSession, heads)
        discard(docs.sparkSession, active)
        if open_rows.isEmpty():
            break
        if turn < rounds:
            pairs = open_rows.where("c <> hc").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
            alike = stage(_alike(pairs, sketches, cut), "near-pairs")
            sets = _sets_of(alike.select(F.explode(F.array("a", "b")).alias("id")), docs, width)
            found = _verified(alike, sets, percent)
        else:
            sets, alike = _sets_of(open_rows.select("id"), docs, width), None
            found = _prefix_links(open_rows.select("id", "c").distinct(), sets, percent)
        discard(docs.sparkSession, alike, sets)
        if not found.isEmpty():
            links.append(found)
            part = stage(connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("id", "node"), "near-parts")
        active = stage(open_rows.where("id <> head").select("key", "id"), "near-buckets")
        discard(docs.sparkSession, open_rows)

    whole = full.select("doc_id", "n_shingles", "fp").join(groups.select("fp", "id"), "fp")
    if part is not None:
        whole = whole.join(part, whole.id == part.node, "left")
    else:
        whole = whole.withColumn("component_id", F.lit(None).cast("long"))
    whole = whole.select("doc_id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    alone = signed.where("fp is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that near-duplicate detection keeps: one document a group.

    Of repeated rows of one doc_id the one whose text has the smallest hash stays; rows with null doc_id all stay.
    """
    judged = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id")
    ids = stage(judged.groupBy("doc_id").agg(F.count("*").alias("n")), "near-kept")
    kept = semi_by_id(docs, ids.select("doc_id"), "doc_id", ids.count())
    again = ids.where("n > 1").select("doc_id")
    if not again.isEmpty():
        few = small(again)
        one = kept.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("r"))
        kept = kept.join(few, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("r.*"))
    return kept.unionByName(docs.where("doc_id is null"))
