"""Ground-truth JSON: reading with defaults, writing, checking, and finding a document's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES

SCHEMA = "document string, document_id string, created_at string, annotations array<struct<annotation_id:string,entity_type:string,start:int,end:int,paragraph_index:int>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, gt_id, entity_type, paragraph_index, start, end); unknown categories go, ids default to gt_n."""
    raw = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    rows = raw.select(F.coalesce("document", "document_id", F.lit("unknown_doc")).alias("doc_id"), F.posexplode("annotations").alias("n", "a"))
    rows = rows.where(F.col("a.entity_type").isin(CATEGORIES))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    return rows.select("doc_id", F.coalesce("a.annotation_id", F.concat(F.lit("gt_"), number.cast("string"))).alias("gt_id"), "a.entity_type", F.coalesce("a.paragraph_index", F.lit(0)).alias("paragraph_index"), "a.start", "a.end")


def write(truth: DataFrame, path: str) -> None:
    """One JSON document a line, without the text that was marked; absent fields are left out."""
    rows = truth.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("gt_id", "entity_type", "start", "end", "paragraph_index"))).alias("g"))
    rows.select(F.col("doc_id").alias("document"), F.transform("g", lambda g: F.struct(g["gt_id"].alias("annotation_id"), g["entity_type"].alias("entity_type"), g["start"].alias("start"), g["end"].alias("end"), g["paragraph_index"].alias("paragraph_index"))).alias("annotations")).write.json(path)


def in_bounds(start: Column, end: Column, text: Column) -> Column:
    """Whether an annotation lies inside its paragraph and holds something."""
    return F.coalesce((start >= 0) & (start < end) & (end <= F.length(text)), F.lit(False))


def registry(spark: SparkSession, truths: dict[str, str]) -> DataFrame:
    """(file_name, truth_path), file names in lower case."""
    return spark.createDataFrame([(name.lower(), path) for name, path in truths.items()], "file_name string, truth_path string")


def registry_key(path: Column) -> Column:
    """A file's name as the registry has it: lower case, without folders and a leading `redacted_`."""
    return F.regexp_replace(F.lower(F.trim(F.element_at(F.split(path, r"[/\\]"), -1))), "^redacted_", "")


def lookup(files: DataFrame, known: DataFrame) -> DataFrame:
    """files(doc_id, ...) with truth_path, null where there is no ground truth; known is a small registry."""
    return files.withColumn("file_name", registry_key(F.col("doc_id"))).join(F.broadcast(known), "file_name", "left").drop("file_name")
