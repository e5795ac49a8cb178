"""Queries of the corpus operators over the whole driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_join, html_extract, langid, licenses, lm_score, minhash, packing, quality, warc


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.warc_dedup(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    target = _table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return lm_score.score(docs, lm_score.train(docs, target), leave_own_out=True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_packing, op2_warc, op3_embedding_near_dedup, op4_html_extraction, op5_lm_scoring, op6_bpe, op7_quality_rules, op8_license_scan, op9_minhash_near_dedup, op10_language_id]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality.oracle_sql(), "op8_license_scan": licenses.oracle_sql(), "op3_embedding_near_dedup": EMBEDDINGS_SQL, "op9_minhash_near_dedup": SHINGLES_SQL, "op2_warc": WARC_SQL}


# Base32 of the SHA-1 from its hexadecimal digits: 32 groups of five bits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5),
    lambda k: (((strpos('0123456789abcdef', substr(x, (1 + (5 * i + k) // 4)::INT, 1)) - 1) >> (3 - (5 * i + k) % 4)::INT) & 1) << (4 - k)::INT))::INT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
FROM r"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.w FROM reach JOIN links ON reach.r = links.u),
parts AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON vec_id = parts.id LEFT JOIN counts ON vec_id = u"""

SHINGLES_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM docs)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.v FROM reach JOIN links ON reach.r = links.u),
parts AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN parts ON documents.doc_id = parts.id LEFT JOIN n ON n.doc_id = documents.doc_id"""
