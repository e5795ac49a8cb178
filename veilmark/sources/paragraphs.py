"""Paragraph views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Paragraphs with every category, made from customer keys; the same text runs in Spark and DuckDB.
TEMPLATES = """
SELECT 10000000 + c_custkey % 997 AS doc_id, CAST(c_custkey AS INT) AS paragraph_index,
  CASE c_custkey % 9
    WHEN 0 THEN concat('Contact Rohan Dey at rohan.dey', c_custkey % 50, '@mail', c_custkey % 7, '.com or +91 98', lpad(CAST(c_custkey % 100000000 AS VARCHAR(20)), 8, '0'), ' today.')
    WHEN 1 THEN concat('US citizen SSN is ', lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR(20)), 3, '0'), '-', lpad(CAST(c_custkey % 100 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(c_custkey * 13 % 10000 AS VARCHAR(20)), 4, '0'), ' on file.')
    WHEN 2 THEN concat('Date of Birth: ', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR(20)), 2, '0'), '/08/', CAST(1950 + c_custkey % 50 AS VARCHAR(20)), ' for the record.')
    WHEN 3 THEN concat('Mailing address: ', CAST(c_custkey % 900 + 10 AS VARCHAR(20)), ' Mahatma Gandhi Road, Bangalore ', CAST(560000 + c_custkey % 99 AS VARCHAR(20)), ', India.')
    WHEN 4 THEN concat('Approved by Apex', CAST(c_custkey % 40 AS VARCHAR(20)), ' Technologies Pvt Ltd today. Signed by ', CASE c_custkey % 4 WHEN 0 THEN 'Rohan Dey' WHEN 1 THEN 'Alice Stone' WHEN 2 THEN 'Mira Patel' ELSE 'Parker Quarry' END, ' and Omar Reyes.')
    WHEN 5 THEN concat('Pay using card 4111-1111-1111-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0'), ' now.')
    WHEN 6 THEN concat('Server IP is 10.', CAST(c_custkey % 300 AS VARCHAR(20)), '.7.', CAST(c_custkey % 250 AS VARCHAR(20)), ' and 2001:db8::', CAST(c_custkey % 9000 + 1000 AS VARCHAR(20)), ' and version 1.2.3.4 is software, as is v10.0.0.1 here.')
    WHEN 7 THEN concat('Assignment: reviewed by Apex', CAST(c_custkey % 40 AS VARCHAR(20)), ' Labs and filed on 15/08/1990.')
    ELSE concat('Email (alice', CAST(c_custkey % 30 AS VARCHAR(20)), '@example.org). Call (+1-800-555-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0'), ') today.')
  END AS text
FROM customer"""


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents.text as (doc_id, paragraph_index, text); null text has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text"))


def template_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEMPLATES.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def conversation_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a conversation's turns as (doc_id, paragraph_index, text), numbered through the whole conversation."""
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "line", "text")) - 1
    return lines.select("doc_id", number.alias("paragraph_index"), "text")


def all_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paragraphs(spark, sf_dir).unionByName(template_paragraphs(spark, sf_dir))
