"""Defined cases of every operator, long inputs, brute-force versions of the template deduction and of the whole pipeline."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veilmark.llm import bpe, common, embed_join, html_extract, langid, licenses, lm_score, minhash, packing, quality, warc

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
#: Names that the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n int, key string, words string, s string, c int, id int, target int, sorted int"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "src", 1, "k", "w", "s", 2, 3, 4, 5) for r in rows], CLASH)


def filters(docs):
    return langid.train(docs.where(~langid.held_out()))


OPERATORS = {
    "packing": lambda d: packing.pack(d, WORD_BPE),
    "bpe": lambda d: bpe.bpe_encode(d, BYTE_BPE),
    "quality": quality.quality,
    "keep_good": quality.keep_good,
    "licenses": licenses.license_scan,
    "minhash": minhash.near_duplicates,
    "keep_one_each": minhash.keep_one_each,
    "langid": lambda d: langid.identify(d, filters(d)),
    "keep_identified": lambda d: langid.keep_identified(d, filters(d)),
    "lm": lambda d: lm_score.score(d, lm_score.train(d, d.where("doc_id = 1").select("doc_id")), leave_own_out=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_clashes_and_empty_tables(spark, name):
    text = "the quick brown fox and the lazy dog are in the house of the old man " * 6
    rows = [(1, text, "en"), (1, text, "en"), (2, None, None), (None, text, None), (3, "", "en"), (4, " \n\t ", None), (5, "12 34", "en"), (6, text + "x", "en"), (None, None, None)]
    docs = frame(spark, rows)
    got = OPERATORS[name](docs).collect()
    if name in ("packing", "bpe", "quality", "licenses", "minhash", "langid", "lm"):
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        same = [tuple(r[c] for c in r.__fields__ if c not in ("sequence_id", "offset")) for r in got if r.doc_id == 1]
        assert same[0] == same[1]
    else:
        assert all(set(r.__fields__) == set(docs.columns) and r.source == "src" for r in got)
    assert OPERATORS[name](docs.where("false")).count() == 0


def test_empty_tables_of_pages_and_vectors(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, host string, tokens int")
    assert html_extract.main_text(pages).count() == 0
    assert warc.warc_dedup(pages)[0].count() == 0
    assert embed_join.embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, id int, v int")).count() == 0


def test_long_words_merge_in_little_time():
    rng, own, library = random.Random(1), bpe.ByteBpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for n in (3, 64, 65, 66, 200, 40_000):
        word = "".join(rng.choice("abcdeetaoin") for _ in range(n))
        assert own.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
    began = time.time()
    own.encode_rows(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))])
    assert time.time() - began < 20


def test_remembered_words_are_bounded_and_change_nothing():
    memory = common.Remembered(limit=20_000, marks=1 << 10)
    for k in range(2000):
        memory.keep({f"w{k % 900}": b"x" * 4})
    assert memory.size <= 20_000 + 400 and memory.known
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6))) for _ in range(200)) for _ in range(60)]
    tokens, library = packing.WordTokens(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    tokens.words = common.Remembered(limit=5_000, marks=1 << 8)
    for _ in range(2):
        assert tokens(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_every_token_lies_in_one_piece(spark):
    rng = random.Random(8)
    texts = ["word " * rng.choice([0, 3, 40, 255, 256, 300, 1100]) for _ in range(120)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD_BPE, capacity=256, grain=4).collect()
    for doc, group in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        at = 0
        for r in group:
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(texts[doc].split()) + 1
    used = {r.sequence_id for r in rows}
    assert used == set(range(len(used))) and len(used) * 256 - sum(r.length for r in rows) <= 0.05 * len(used) * 256 + 2 * 256


def test_linear_program_reaches_the_optimum():
    def fewest(histogram, capacity):
        """Sequences needed, by trying every filling of the next one."""
        best = {}

        def solve(left):
            if not any(left):
                return 0
            if left not in best:
                first = next(i for i, n in enumerate(left) if n)
                best[left] = min(1 + solve(rest) for rest in fillings(left, first))
            return best[left]

        def fillings(left, first):
            out = set()

            def fill(now, room, k):
                fits = False
                for i in range(k, len(sizes)):
                    if now[i] and sizes[i] <= room:
                        fits = True
                        fill((*now[:i], now[i] - 1, *now[i + 1 :]), room - sizes[i], i)
                if not fits:
                    out.add(now)

            fill((*left[:first], left[first] - 1, *left[first + 1 :]), capacity - sizes[first], 0)
            return out

        sizes = sorted(histogram, reverse=True)
        return solve(tuple(histogram[s] for s in sizes))

    rng = random.Random(4)
    for _ in range(25):
        histogram = {s: rng.randrange(1, 5) for s in rng.sample(range(2, 13), 4)}
        plan = packing.plan_sequences(histogram, 13)
        assert {s: sum(p[2] for p in plan if p[0] == s) for s in histogram} == histogram
        used = 1 + max(first + (n - 1) // each for _, _, n, each, first in plan)
        sizes = np.array(sorted(histogram), np.int64)
        _, counts = packing.linear_program(sizes, np.array([histogram[s] for s in sizes.tolist()], float), 13)
        assert counts.sum() <= fewest(histogram, 13) + 0.51 and used <= fewest(histogram, 13) + 1


def page(i, extra="", menu="<div><p>Alpha Beta Gamma</p><p>Second menu line</p></div>"):
    return f"<html><body>{menu}<section><h1>T {i}</h1><p>Body {i} <b>big</b> <i>words</i> {i * 7}</p>{extra}</section></body></html>"


def test_only_the_template_removes_an_unnamed_menu(spark):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(30)] + [(50, "http://h.example/error", "<html><body><p>Error</p></body></html>"), (51, "http://other.example/1", page(1)), (52, "http://h.example/x", page(52, menu=""))]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T {i}\nBody {i} big words {i * 7}" for i in range(30))
    assert got[50] == "Error" and got[51].startswith("Alpha Beta Gamma\n") and got[52] == "T 52\nBody 52 big words 364"


def test_templates_equal_a_brute_force_deduction(spark):
    rng = random.Random(6)
    pages = [(f"http://h{i % 2}.example/{i}", page(i, extra="".join(f"<ul><li>x{k}{i}</li></ul>" for k in range(rng.randrange(3))))) for i in range(40)]
    want = {}
    for host in ("h0.example", "h1.example"):
        vectors = {}
        own = [p for u, p in pages if host in u]
        for k, p in enumerate(own):
            for token, (n, *_, kind) in html_extract.page_tokens(p).items():
                vectors.setdefault(token, ({}, kind))[0][k] = n
        classes = {}
        for token, (vector, kind) in vectors.items():
            if len(vector) >= 8:
                classes.setdefault(tuple(sorted(vector.items())), []).append((token, kind))
        want[host] = {frozenset(t for t, _ in c) for c in classes.values() if len(c) > 1 and any(k for _, k in c)}
    rows = html_extract.templates(spark.createDataFrame([(k, u, p) for k, (u, p) in enumerate(pages)], "page_id long, url string, html string")).collect()
    got = {r.host: {frozenset(t for t, c in zip(r.tokens, r.classes) if c == k) for k in range(len(r.parents))} for r in rows}
    assert got == want and all(any(p >= 0 for p in r.parents) for r in rows)


def test_white_space_names_and_depth_in_pages():
    text = html_extract.extract('<article><b>big</b> <i>words</i> and <a>one</a> <a>two</a><div class="related-work">kept</div><p class="promotion-of-peace">also</p><div class="ad-box">no</div><div id="comments">no</div></article>')
    assert text == "big words and one two\nkept\nalso"
    began = time.time()
    assert html_extract.extract("<div>" * 60_000 + "<li>x</p>" * 2_000).count("x") == 2_000
    assert time.time() - began < 10


def test_scores_do_not_depend_on_pieces(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice("the der house haus and und x1 ß".split()) for _ in range(3000))
    whole = np.sort(np.concatenate(list(langid._grams(text, 1 << 20))))
    for piece in (1, 7, 1000):
        assert (np.sort(np.concatenate(list(langid._grams(text, piece)))) == whole).all()


def test_language_ties_and_held_out_accuracy(spark):
    tie = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["de", "en"] * 20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(tie, langid.train(tie)).collect()} == {"de"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, filters(docs)).select(F.col("doc_id").alias("d"), "lang_pred")
    both = docs.where(langid.held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).join(found, F.col("doc_id") == F.col("d"))
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()


def test_wrapped_notices_are_found(spark):
    lines, line = [], ""
    for word in MIT.split():
        if len(line) + len(word) > 75:
            lines, line = [*lines, line], ""
        line = f"{line} {word}".strip()
    wrapped = "\n".join([*lines, line])
    rows = [(1, f"Copyright\n\n{wrapped}\n\nTHE END"), (2, MIT), (3, "Permission is granted\n\nto use software"), (4, "\n\n")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("mit", 1.0) and got[3] == got[4] == ("", 0.0)


def test_lm_scores_without_own_counts(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("klm") for _ in range(30))) for i in range(60)]
    docs, targets = spark.createDataFrame(rows, "doc_id long, text string"), set(range(0, 60, 3))
    counts = [(Counter(w for i, t in rows if m == 0 or i in targets for w in t.split()), Counter(p for i, t in rows if m == 0 or i in targets for p in zip(t.split(), t.split()[1:]))) for m in (0, 1)]
    vocabulary = len(counts[0][0])

    def loss(i, text, m):
        w, own = text.split(), m == 0 or i in targets
        uni, bi = (c - (Counter(x) if own else Counter()) for c, x in zip(counts[m], (w, list(zip(w, w[1:])))))
        p = [0.4 * uni[x] / max(1, sum(uni.values())) + 0.1 / (vocabulary + 1) for x in w]
        for k in range(1, len(w)):
            p[k] += 0.5 * min(1, bi[w[k - 1], w[k]] / uni[w[k - 1]]) if uni[w[k - 1]] else 0
        return -sum(map(np.log, p)) / len(w)

    got = {r.doc_id: r for r in lm_score.score(docs, lm_score.train(docs, docs.where("doc_id % 3 = 0").select("doc_id"), slots=256), leave_own_out=True).collect()}
    for i, text in rows:
        assert np.allclose((got[i].target_loss, got[i].background_loss), (loss(i, text, 1), loss(i, text, 0)))


def test_large_pages_in_archives(spark):
    rows = [(1, "u", "a" * 8_000_000), (2, "u", "a" * 8_000_000), (3, "u", "small"), (4, "v", "small")]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_dedup(spark.createDataFrame(rows, "page_id long, url string, html string"))[0].collect()}
    assert got == {1: (8_000_000, "response", None), 2: (8_000_000, "revisit", 1), 3: (5, "response", None), 4: (5, "revisit", 3)}


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(90)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(5))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in enumerate(texts)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert want == components(sets, linked)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "SHARE", 4)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, rounds=0).collect()} == want


def components(ids, linked):
    part = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            part[a] = part[b] = min(part[a], part[b])
    return part


def good(text):
    """The rules of the threshold table, counted plainly."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, lines = len(words), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    stop = {w for s in quality.STOP_WORDS.values() for w in s.split()}
    counts = {
        "one": 1, "n_words": n, "n_lines": len(lines), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in quality.SYMBOLS), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(marked), "n_stop_words": sum(w.lower() in stop for w in words), "n_shout_words": sum(len(w) > 1 and w.upper() == w and w.lower() != w for w in words),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•‣·]", x)) for x in lines), "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
    }
    return n >= 50 and 100 * len(marked) <= 50 * n and all(low * counts[bottom] <= counts[top] <= high * counts[bottom] for _, top, bottom, low, high in quality.RULES)


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = filters(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for i, text in texts.items():
        language, _, coverage = model.decide(text)
        if language != "und" and coverage >= 0.2 and good(text or ""):
            kept[i] = text
    sets = {i: set(zip(*[t.encode().lower().split()[k:] for k in range(5)])) for i, t in kept.items()}
    part = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    library = Tokenizer.from_file(WORD_BPE)
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in kept.items() if part[i] == i}
    want = sorted((i, s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())) for i, x in ids.items() for s in range(0, len(x), 4096))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == want and 0 < len(ids) < len(texts)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        group = list(group)
        ends = list(itertools.accumulate((r.length for r in group), initial=0))
        assert [r.offset for r in group] == ends[:-1] and ends[-1] <= 4096
