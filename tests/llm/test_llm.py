"""Operators against brute force, round trips and defined cases on small fixtures."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilmark.llm import bpe, embed_join, html_extract, langid, licenses, lm_score, minhash, packing, quality, warc
from veilmark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, n_shingles string, rank int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [words(rng, 60) for _ in range(6)]
    texts = [None, "", " \n\t", "one two", "ONE two", "one", base[0], base[0], base[0].upper(), words(rng, 4000)]
    for b in base:
        for edits in (1, 1, 2, 3, 5, 9):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts.append(" ".join(w))
    return texts + [words(rng, 30) + " " + base[1] for _ in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", i) for i, t in enumerate(corpus())]
    return spark.createDataFrame([*rows, rows[7], (None, "lost", None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(ids, linked):
    part = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(part[a], part[b])
            if part[a] != low or part[b] != low:
                part[a] = part[b] = low
                changed = True
    return part


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_minhash(spark, docs):
    def shingles(t):
        w = t.encode().lower().split() if t else []
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in enumerate(corpus())}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = brute_components(sets, linked)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all(r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    kept = [r.doc_id for r in minhash.keep_one_each(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i in want if want[i] == i) and None in kept


def test_prefix_links_lose_nothing(spark):
    rng = random.Random(5)
    base = words(rng, 80).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    sets = {i: minhash.shingle_set(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "id long, s array<long>")
    rest = spark.createDataFrame([(i, i) for i in sets], "id long, c long")
    got = {(r.u, r.v) for r in minhash._prefix_links(rest, frame, 75).collect()}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert got == want


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=256, grain=4).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(corpus())}
    for r in rows:
        if r.doc_id is not None:
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(r.length for r in rows if r.doc_id is not None) == sum(map(len, ids.values())) + len(ids[7])
    assert packing.pack(empty(spark), path).count() == 0


def test_tokens_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    texts = ["", "İstanbul ΑΣ é 日本", "a<|endoftext|>b", "don't we'll ²¼"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 256), 10, 32, 39])) for _ in range(40)) for _ in range(400)]
    got = packing.WordTokens(path)(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = [None, "", "x<|endoftext|> y", "naïve 日本語 \U0001f600 x́", "  \n\n a"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), 10, 32])) for _ in range(60)) for _ in range(300)]
    rows = bpe.bpe_encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, keep_ids=True).collect()
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == (texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_warc(spark):
    rows = [(3, "http://a/", "x"), (1, "http://b/ c", "x"), (2, None, ""), (4, "u", None), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "x")]
    got, _ = warc.warc_dedup(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    five = rows[4][2]
    want = [(3, 1, digest("x"), "revisit", 1), (1, 1, digest("x"), "response", None), (2, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 2), (None, 1, digest("x"), "revisit", 1)]
    want += [(5, len(five.encode()), digest(five), "response", None), (5, len(five.encode()), digest(five), "revisit", 5)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    v = np.vstack([base, base[:20] + rng.normal(size=(20, 16)) * 0.15, base[:10] * 2.5])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, 2.0])]
    got = {r.vec_id: r for r in embed_join.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_size=7).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    close = u @ u.T >= 0.95
    want = brute_components(range(len(v)), [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    assert len(got) == len(rows)
    assert all(got[i].n_links == close[i].sum() - 1 and got[i].component_id == want[i] for i in range(len(v)))
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904))


def test_html(spark):
    page = lambda i: f'<html><body class="with-sidebar"><nav>menu {i}</nav><article><h1>T {i} &amp; x</h1><p>Share this story with all of your many friends<p>Body {i} <b>bold</b> tail words {i * 7} that differ here<div class="ad">buy</div></article><footer>f</footer>'
    rows = [(i, "http://h.example/" + str(i), page(i)) for i in range(12)] + [(90, None, None), (91, "x", "<p>a &lt; b<p>c")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T 3 & x\nBody 3 bold tail words 21 that differ here"
    assert got[90] == "" and got[91] == "a < b\nc"
    assert html_extract.extract(page(3)).startswith("T 3 & x\nShare this story")


def test_language_filters(spark):
    rows = [(i, ("the cat and the house " if i % 2 else "der hund und das haus ") * 3, "en" if i % 2 else "de") for i in range(60)]
    rows = spark.createDataFrame([*rows, (98, None, "en"), (99, "12 34", None)], "doc_id long, text string, lang string")
    model = langid.train(rows)
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(60))
    assert got[98].lang_pred == got[99].lang_pred == "und"
    assert langid.train(rows.where("false")).decide("abc")[0] == "und"


def test_quality_and_licenses_cases(spark, docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[0].n_words == got[1].n_words == 0 and got[0].base_failed
    text = "a b c a b c x"
    assert quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_repeat_words == 6
    rows = spark.createDataFrame([(1, "x CC-BY cc by, GNU General Public License"), (2, None), (3, "Released under the MIT License.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(rows).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 6, "cc-by,gpl")
    assert got[2].n_words == 0 and got[2].labels == "" and got[3].labels == "mit" and got[3].n_base == 0


def test_lm_scores(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["red blue green", "one two three"][i % 2].split()) for _ in range(40))) for i in range(80)]
    frame = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    model = lm_score.train(frame, frame.where("doc_id % 2 = 0 and doc_id < 40").select("doc_id"), slots=1 << 12)
    got = {r.doc_id: r for r in lm_score.score(frame, model).collect()}
    assert got[99].n_tokens == 0 and got[99].score == 0 and got[99].target_loss is None
    assert max(got[i].score for i in range(0, 80, 2)) < min(got[i].score for i in range(1, 80, 2))
    assert model.unigrams[:, 0].sum() == 80 * 40


def test_lm_scores_keep_every_word_and_bigram(spark):
    rng = random.Random(12)
    made = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = [made() for _ in range(200)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.3 else made() for _ in range(60))) for i in range(300)] + [(400, None), (7, "twice seen")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    targets = {i for i in range(0, 300, 3)}
    uni, bi = ([{}, {}] for _ in range(2))
    for i, text in rows:
        w = (text or "").split()
        for m in range(1 + (i in targets)):
            for x in w:
                uni[m][x] = uni[m].get(x, 0) + 1
            for x in zip(w, w[1:]):
                bi[m][x] = bi[m].get(x, 0) + 1
    assert len(uni[0]) > 8191

    def loss(w, m):
        p = [0.4 * uni[m].get(x, 0) / sum(uni[m].values()) + 0.1 / (len(uni[0]) + 1) for x in w]
        for k in range(1, len(w)):
            p[k] += 0.5 * bi[m].get((w[k - 1], w[k]), 0) / max(1, uni[m].get(w[k - 1], 0))
        return -sum(map(np.log, p)) / len(w)

    model = lm_score.train(frame, frame.where("doc_id % 3 = 0 and doc_id < 300").select("doc_id"))
    others = [(900, rows[5][1] + " unseen words"), (901, "")]
    for texts, docs in ((rows, frame), (others, spark.createDataFrame(others, "doc_id long, text string"))):
        got = sorted((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lm_score.score(docs, model).where("n_tokens > 0").collect())
        want = sorted((i, len(t.split()), loss(t.split(), 1), loss(t.split(), 0)) for i, t in texts if t)
        assert len(got) == len(want)
        assert all(g[:2] == w[:2] and np.allclose(g[2:], (*w[2:], w[2] - w[3]), atol=1e-9) for g, w in zip(got, want))


def test_html_templates_bear_empty_pages_and_layouts(spark):
    first = lambda i: f"<html><body><article><h1>T {i}</h1><p>Share this story with all of your many friends<p>Body {i} words</article></body></html>"
    second = lambda i: f"<html><body><section><article><h2>U {i}</h2><p>Read the terms before you write to us</p><p>Text {i} words</p></article></section></body></html>"
    rows = [(i, f"http://h.example/{i}", first(i)) for i in range(20)] + [(100 + i, f"http://h.example/b{i}", second(i)) for i in range(20)]
    rows += [(200, "http://h.example/none", None), (201, "http://h.example/void", ""), (202, "http://h.example/error", "<html><body><p>Error 500</body></html>")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"T {i}\nBody {i} words" and got[100 + i] == f"U {i}\nText {i} words" for i in range(20))
    assert got[200] == got[201] == "" and got[202] == "Error 500"


def test_prefix_links_bear_repeated_rows(spark):
    rng = random.Random(5)
    base = words(rng, 80).split()
    texts = []
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(1 + (i % 3 == 0))]
    ids = spark.createDataFrame([(i,) for i in range(30)], "id long")
    sets = minhash._sets_of(ids, spark.createDataFrame(rows, "doc_id long, text string"), 5)
    got = {(r.u, r.v) for r in minhash._prefix_links(ids.withColumn("c", ids.id), sets, 75).collect()}
    found = {i: minhash.shingle_set(t) for i, t in enumerate(texts)}
    want = {(a, b) for a, b in itertools.combinations(found, 2) if 100 * len(np.intersect1d(found[a], found[b])) >= 75 * len(np.union1d(found[a], found[b]))}
    assert got == want
