"""Language identification with bit-sliced Bloom filters over character n-grams.

Training counts n-grams of sampled labelled texts per language and keeps, for each language, those
frequent enough in it and not rare in it against the language that has them most. Each kept n-gram sets its
language's bit at `hashes` slots, so one look-up (the AND of those slots) returns all languages containing an
n-gram as a bitmask. A text's n-grams are popcounted per language, the counts are corrected for the filter's
false-positive rate, and the largest share decides.

The sample of labelled rows is bounded by max_train_docs (a documented parameter; rows are taken by a
hash of their id); prediction reads whole texts of all rows. The model's size is fixed by slots; the n-grams that reach the driver are
those of the sample that occur min_count times or more, so they are bounded by the sample's texts. A language whose sampled texts
hold no n-gram min_count times is not learned.

A text's words are joined once and its n-grams taken in pieces of the code points, each n-gram in the piece where it starts, so memory
stays bounded and a score does not depend on the pieces.

Defined cases: null text, or text without letters, is `und` with score 0; where no n-gram counts
for any language the most common learned language is returned with score 0; without any learned language all
rows are `und`; of languages with equal counts the first by name wins; rows with null lang or null text teach nothing; repeated rows are predicted
each; columns other than doc_id, text and lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64

UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+").sub
_SIZES = (2, 3, 4)
_STEP = np.uint64(0x100000001B3)
#: Code points of a text whose n-grams are held at once.
PIECE = 1 << 17


def _grams(text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """64-bit codes of the n-grams of the letters of a text, words apart by one space, by the piece in which they start."""
    whole = np.frombuffer(f" {_GAP(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(whole), piece):
        points = whole[at : at + piece + _SIZES[-1] - 1].astype(np.uint64)
        out, acc = [], np.zeros(len(points), np.uint64)
        for n in range(1, _SIZES[-1] + 1):
            if len(points) < n:
                break
            acc = acc[: len(points) - n + 1] * _STEP + points[n - 1 :] + np.uint64(1)
            if n in _SIZES:
                out.append(acc[:piece] * np.uint64(8) + np.uint64(n))
        yield np.concatenate(out) if out else np.empty(0, np.uint64)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Filters:
    """Bit-sliced Bloom filters: words[slot, w] holds the bits of languages 64w to 64w + 63."""

    languages: list[str]
    words: np.ndarray
    hashes: int
    false_rate: np.ndarray
    fallback: str

    def positions(self, grams: np.ndarray) -> list[np.ndarray]:
        bits = np.uint64(self.words.shape[0] - 1)
        return [(mix64(grams + np.uint64(k)) & bits).astype(np.int64) for k in range(self.hashes)]

    def add(self, language: int, grams: np.ndarray) -> None:
        for at in self.positions(grams):
            self.words[at, language // 64] |= np.uint64(1) << np.uint64(language % 64)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Bitmasks of all languages containing each n-gram."""
        first, *rest = self.positions(grams)
        masks = self.words[first]
        for at in rest:
            masks = masks & self.words[at]
        return masks

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """Per-language popcounts corrected for false positives, and the number of n-grams."""
        total, n = np.zeros(len(self.languages)), 0
        for grams in _grams(text):
            masks = self.lookup(grams)
            n += len(grams)
            for k in range(len(self.languages)):
                total[k] += np.count_nonzero(masks[:, k // 64] & (np.uint64(1) << np.uint64(k % 64)))
        return np.maximum(0, (total - n * self.false_rate) / (1 - self.false_rate)), n

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, share of the n-grams that the language explains)."""
        if not self.languages or not _has_letter(text):
            return UNKNOWN, 0.0, 0.0
        counts, n = self.hits(text)
        best = int(counts.argmax())
        if counts[best] <= 0:
            return self.fallback, 0.0, 0.0
        return self.languages[best], float(counts[best] / counts.sum()), float(min(1.0, counts[best] / n))


def train(docs: DataFrame, max_train_docs: int = 12_000, slots: int = 1 << 20, hashes: int = 2, min_count: int = 5, min_ratio: float = 0.25) -> Filters:
    """Filters learned from docs(doc_id, text, lang); rows with null lang or text teach nothing."""
    labelled = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).where("lang is not null")
    n = labelled.select("doc_id").count()
    if n > max_train_docs:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < ceil((1 << 20) * max_train_docs / n))

    def count(cols: dict) -> dict:
        out: dict = {"lang": [], "gram": [], "n": []}
        by: dict[str, list[np.ndarray]] = {}

        def emit(lang: str, grams: list[np.ndarray]) -> None:
            gram, times = np.unique(np.concatenate(grams), return_counts=True)
            out["lang"] += [lang] * len(gram)
            out["gram"].append(gram.view(np.int64))
            out["n"].append(times.astype(np.int64))

        for text, lang in zip(cols["text"], cols["lang"]):
            if _has_letter(text):
                for grams in _grams(text):
                    by.setdefault(lang, []).append(grams)
                    if sum(map(len, by[lang])) > 4 * PIECE:
                        emit(lang, by.pop(lang))
        for lang, grams in by.items():
            emit(lang, grams)
        return {"lang": out["lang"], **{c: np.concatenate(out[c]) if out[c] else np.empty(0, np.int64) for c in ("gram", "n")}}

    counts = arrow_map(labelled.select("text", "lang"), count, "lang string, gram long, n long", pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    # The n-grams of at most max_train_docs texts, without the rare ones.
    table = counts.toArrow()
    names = np.array(table.column("lang").to_pylist(), object)
    gram, times = (table.column(c).to_numpy() for c in ("gram", "n"))
    languages = sorted(set(names.tolist()))
    model = Filters(languages, np.zeros((slots, max(1, ceil(len(languages) / 64))), np.uint64), hashes, np.zeros(len(languages)), UNKNOWN)
    if not languages:
        return model
    code = np.searchsorted(np.array(languages, object), names)
    sums = np.bincount(code, times, len(languages))
    model.fallback = languages[int(sums.argmax())]
    rate = times / sums[code]
    kinds, group = np.unique(gram, return_inverse=True)
    top = np.zeros(len(kinds))
    np.maximum.at(top, group, rate)
    keep = rate >= min_ratio * top[group]
    for k in range(len(languages)):
        model.add(k, gram[keep & (code == k)].view(np.uint64))
        filled = np.count_nonzero(model.words[:, k // 64] & (np.uint64(1) << np.uint64(k % 64))) / slots
        model.false_rate[k] = filled**hashes
    return model


def identify(docs: DataFrame, model: Filters) -> DataFrame:
    """(doc_id, lang_pred, score, coverage) of every row of docs, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(cols: dict) -> dict:
        got = [shared.value.decide(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "coverage": [g[2] for g in got]}

    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, lang_pred string, score double, coverage double", arrow)


def keep_identified(docs: DataFrame, model: Filters, min_coverage: float = 0.2) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known and explains enough of the text's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = (shared.value.decide(t) for t in part.column(column).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and coverage >= min_coverage for lang, _, coverage in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out() -> F.Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; such documents teach nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
