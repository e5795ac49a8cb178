"""Byte-level BPE encoding by speculation, and decoding.

A text splits into words by the vocabulary's pattern. For each word not met before, greedy
longest match proposes tokens; a proposal is the BPE encoding exactly when every token encodes to
itself and every adjacent pair encodes to that pair, so one vectorised look-up over all adjacent
pairs of a batch verifies the proposals, and only failing words go through exact merging, in n log n steps
for a word of any length. The answer for each pair and each word is remembered, up to a bounded size.

Defined cases: null text counts as empty and has no tokens; the special token's string in a
text is that token; texts and words of any length are encoded whole; repeated rows are encoded each, extra columns change
nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, arrow_map, resident

# Fixed value: the public byte-level pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
#: The same pattern over the characters of PLAIN, where the standard library's engine is faster.
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xff]*")
PAIRS_KEPT = 2_000_000
_NEVER = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.id_of = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        #: Pair of ids in one number, to the pair's rank and the merged id in one number.
        self.rank = {vocab[a] << 20 | vocab[b]: r << 20 | vocab[a + b] for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.id_of_byte = [self.id_of[bytes([c])] for c in range(256)]
        self.longest: dict[bytes, int] = {}
        for b in self.id_of:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self.split = regex.compile(PATTERN).findall
        self.split_plain = re.compile(PLAIN_PATTERN).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = Remembered(300_000_000, entry=400, letter=8)
        self.whole: dict[int, bool] = {}
        self.pair_codes = np.empty(0, np.int64)
        self.pair_fits = np.empty(0, bool)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, leftmost among equals."""
        ids = [self.id_of_byte[c] for c in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.rank.get
        ranks = [get(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap of ranks and places over a linked list."""
        get, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != best:
                continue  # one of the pair was merged since
            ids[i], ids[j] = best & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        if (one := self.id_of.get(word)) is not None:
            return [one]
        ids, at, n = [], 0, len(word)
        while at < n:
            size = min(self.longest.get(word[at : at + 2], 1), n - at)
            while size > 1 and word[at : at + size] not in self.id_of:
                size -= 1
            ids.append(self.id_of[word[at : at + size]])
            at += size
        return ids

    def _self_encoding(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return self.whole[token]

    def _fits(self, code: int) -> bool:
        a, b = divmod(code, self.size)
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def fitting(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair code a * size + b is the encoding of its own bytes."""
        pairs, back = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_codes, pairs), max(0, len(self.pair_codes) - 1))
        known = self.pair_codes[at] == pairs if len(self.pair_codes) else np.zeros(len(pairs), bool)
        fits = np.zeros(len(pairs), bool)
        fits[known] = self.pair_fits[at[known]]
        fits[~known] = [self._fits(c) for c in pairs[~known].tolist()]
        if len(self.pair_codes) < PAIRS_KEPT:
            codes_now = np.concatenate([self.pair_codes, pairs[~known]])
            order = np.argsort(codes_now, kind="stable")
            self.pair_codes, self.pair_fits = codes_now[order], np.concatenate([self.pair_fits, fits[~known]])[order]
        return fits[back]

    def learn(self, words: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """Each word's number of tokens, ids joined by commas, and decoded bytes."""
        texts = list(words)
        raws = [w.encode("utf-8", "surrogatepass") for w in texts]
        ids = [self.propose(b) for b in raws]
        bad = {k for k, x in enumerate(ids) if not all(map(self._self_encoding, x))}
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(ids)), sizes)
        inside = owner[1:] == owner[:-1]
        codes = (flat[:-1] * self.size + flat[1:])[inside]
        if len(codes):
            bad.update(owner[1:][inside][~self.fitting(codes)].tolist())
        for k in bad:
            ids[k] = self.merge(raws[k])
        return {w: (len(x), ",".join(map(str, x)), b"".join([self.bytes_of[i] for i in x])) for w, x in zip(texts, ids)}

    def parts(self, text: str) -> list[str]:
        """The words of a text in order, special tokens among them."""
        if PLAIN.fullmatch(text):
            cut = self.split_plain
        else:
            cut = self.split
        if self.at_special is None or not any(s in text for s in self.special):
            return cut(text)
        out: list[str] = []
        for k, piece in enumerate(self.at_special.split(text)):
            out += ["\0" + piece] if k % 2 else cut(piece)
        return out

    def encode_rows(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(tokens, ids joined by commas, decoded text) of each text."""
        rows, at = [], 0
        while at < len(texts):
            batch, size = [], 0
            while at < len(texts) and size < 1_000_000:
                batch.append(self.parts(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            known = self.words.known
            new = {w for x in batch for w in x if w not in known}
            marks = {w for w in new if w[0] == "\0" and w[1:] in self.special}
            learnt = self.learn(new - marks) if new - marks else {}
            learnt |= {w: (1, str(self.special[w[1:]]), w[1:].encode()) for w in marks}
            get = known.get
            for x in batch:
                sizes, ids, raw = zip(*[get(w) or learnt[w] for w in x]) if x else ((), (), ())
                rows.append((sum(sizes), ",".join(ids), b"".join(raw).decode("utf-8", "replace")))
            self.words.keep(learnt)
        return rows


def load(path: str) -> ByteBpe:
    return resident(("bpe", path), lambda: ByteBpe(path))


def bpe_encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row of docs.

    path is the vocabulary file's place, readable on every executor (it ships with the environment).
    """

    def rows(cols: dict) -> dict:
        got = load(path).encode_rows(cols["text"])
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        out = {"doc_id": cols["doc_id"], "n_tokens": [g[0] for g in got], "ids_sha256": [sha(g[1]) for g in got], "decoded_sha256": [sha(g[2]) for g in got]}
        if keep_ids:
            out |= {"ids": [[int(i) for i in g[1].split(",")] if g[1] else [] for g in got], "decoded": [g[2] for g in got]}
        return out

    schema, arrow = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if keep_ids:
        schema, arrow = schema + ", ids array<int>, decoded string", [*arrow, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema, pa.schema(arrow))
