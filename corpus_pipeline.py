"""A corpus pipeline of four stages: language ID, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. run() writes every stage's
result as Parquet in the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm import langid, minhash, packing, quality
from veilmark.llm.common import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones; `und` and unexplained texts go."""
    return langid.keep_identified(docs, langid.train(docs.where(~langid.held_out())))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep every rule of the threshold table."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return minhash.keep_one_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, seated in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("quality_rules", apply_quality_rules), ("minhash_near_dedup", drop_near_duplicates), ("packing", pack_sequences)]

#: Language ID and tokenisation have no SQL form; tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        out = function(spark, out if k == 0 else stage(out, f"pipeline-{STAGES[k - 1][0]}"), sf_dir)
    return out
