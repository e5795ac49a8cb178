"""Whole documents from file to file: scan, detect, map, rewrite, look through the result, and evaluate."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings
from ..functions.patterns import CATEGORIES
from ..scratch import held
from ..sources import docx, ground_truth
from . import detect as D
from . import evaluate as E
from . import mapping as M
from . import redact as X
from . import service

#: Fields of a response, one JSON document a file; no field holds text of a document.
RESPONSE = ["status", "filename", "detections", "total_detections", "replacements_applied", "validation", "download_id", "timing_ms", "evaluation", "detection_audit"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def safe_name(name: Column) -> Column:
    """A file name that can't leave its folder."""
    return F.when(name.rlike(r"\.\.|[/\\]"), F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")).otherwise(name)


def output_name(path: Column) -> Column:
    return F.concat(F.lit("redacted_"), base_name(path))


def redacted(files: DataFrame, model: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """The tables of one batch of files(doc_id, content, status), each computed once: paragraphs, detections, mapping, files."""
    paragraphs = held(docx.scan_files(files), "docx-paragraphs")
    good = paragraphs.where("status = 'ok'")
    spans = held(D.exploded(D.annotate(good.select("doc_id", "paragraph_index", "text"), model=model)), "docx-detections")
    location = good.select("doc_id", "paragraph_index", "region", "runs")
    found = spans.join(location, ["doc_id", "paragraph_index"]).withColumn("run_indices", D.run_indices(F.col("runs"), F.col("start"), F.col("end"))).drop("runs")
    mapping = held(M.entity_map(spans), "docx-mapping")
    links = good.select("doc_id", F.explode("relationships").alias("r")).select("doc_id", F.col("r.target").alias("target")).where("target is not null").distinct()
    instructions = good.select("doc_id", F.explode("fields").alias("instruction")).distinct()
    needles = mapping.where(X.searchable(F.col("entity_type"), F.col("original"))).select("doc_id", F.explode(F.array_distinct(F.array(F.lower("original"), "normalized"))).alias("needle")).distinct()
    out = docx.redact_files(files.where("status = 200").select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(good.select("doc_id").distinct(), "doc_id"), X.tasks(spans, mapping), X.rewrite_links(links, mapping), X.rewritten_fields(instructions, mapping), needles)
    return {"paragraphs": paragraphs, "detections": found, "mapping": mapping, "files": held(out, "docx-files")}


def _folder(path: str) -> str:
    parsed = urlparse(path)
    return ("" if parsed.scheme in ("", "file") else f"{parsed.scheme}://{parsed.netloc}") + "/" + unquote(parsed.path).strip("/")


def write_files(files: DataFrame, target: str) -> DataFrame:
    """(doc_id, path): files(doc_id, file_name, content) written below target, a folder that all machines reach.

    A name that several files of a batch share gets a hash of its source's path. A repeated task writes the same bytes to the same place.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(target if "://" in target else "file://" + target)
        system.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for name, content in zip(batch.column(1).to_pylist(), batch.column(2)):
                paths.append(f"{root.rstrip('/')}/{name}")
                with system.open_output_stream(paths[-1]) as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["doc_id", "path"])

    names = files.groupBy("file_name").agg(F.count("*").alias("same"))
    apart = F.when(F.col("same") > 1, F.concat(F.substring(F.sha2("doc_id", 256), 1, 8), F.lit("_"), "file_name")).otherwise(F.col("file_name"))
    return files.join(names, "file_name").select("doc_id", apart.alias("file_name"), "content").mapInArrow(put, "doc_id string, path string")


def redact_documents(spark: SparkSession, source: str, target: str, truths: dict[str, str] | None = None, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a file below source: its response, and the path of the redacted file below target.

    Columns: doc_id, http_status, error (JSON, null where all went well), path, created_at and the fields of RESPONSE. Refuses a target that is the
    source or lies inside it. truths names ground-truth files by document name; only documents with one are evaluated.
    timing_ms holds the batch's stages.
    """
    if (_folder(target) + "/").startswith(_folder(source) + "/"):
        raise ValueError("the target must not be the source or lie inside it: redacted files would replace or join their originals")
    clock, took = time.time(), {}

    def lap(name: str) -> None:
        nonlocal clock
        took[name], clock = round(1000 * (time.time() - clock), 2), time.time()

    files = held(docx.files_below(spark, source, settings(spark).max_bytes), "docx-input")
    lap("parsing")
    tables = redacted(files, model)
    lap("redaction")
    done, found = tables["files"], tables["detections"]
    written = held(write_files(done.select("doc_id", output_name(F.col("doc_id")).alias("file_name"), "content"), target), "docx-written")
    again = docx.files_below(spark, source, settings(spark).max_bytes).select("doc_id", F.sha2("content", 256).alias("after"))
    lap("validation")
    known = ground_truth.registry(spark, truths or {"": ""})
    judged = ground_truth.lookup(files.select("doc_id"), known).where("truth_path is not null")
    scores = _evaluations(spark, judged, found)
    lap("evaluation")
    counts = found.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("detections"), F.sum("n").alias("total_detections"))
    audit = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("paragraph_index", "start", F.col("entity_type").alias("category"), F.col("region").alias("location_type"), "recognizer"))).alias("a"))
    audit = audit.select("doc_id", F.transform("a", lambda x: F.struct(x["category"].alias("category"), x["paragraph_index"].alias("paragraph_index"), x["location_type"].alias("location_type"), x["recognizer"].alias("recognizer"))).alias("detection_audit"))
    states = tables["paragraphs"].groupBy("doc_id").agg(F.min("status").alias("state"))
    rows = files.select("doc_id", "status", F.sha2("content", 256).alias("before")).withColumnRenamed("status", "gate")
    for other in (states, done.drop("content", "content_sha"), written, again, counts, audit, scores):
        rows = rows.join(other, "doc_id", "left")
    http = F.when(F.col("gate") != 200, F.col("gate")).when(F.col("state") != "ok", 400).otherwise(200)
    ok = http == 200
    total, applied = F.coalesce("total_detections", F.lit(0).cast("long")), F.coalesce("text", F.lit(0))
    checks = F.struct(F.col("valid").alias("document_valid"), (F.col("residual") == 0).alias("original_pii_residual_check"), (F.col("before") == F.col("after")).alias("original_file_hash_unchanged"), (applied == total).alias("replacement_consistency"))
    took["total"] = round(sum(took.values()), 2)
    timing = F.create_map(*[F.lit(x) for pair in took.items() for x in pair])
    none = F.lit("No independent ground truth exists for this document.")
    evaluation = F.coalesce("evaluation", F.to_json(F.struct(F.lit(False).alias("available"), F.lit("user_uploaded").alias("document_type"), none.alias("ground_truth_unavailable_reason"))))
    response = rows.select(
        "doc_id", http.alias("http_status"), service.error_response(http).alias("error"), "path", F.current_timestamp().alias("created_at"),
        F.when(ok, "completed").otherwise("failed").alias("status"), output_name(F.col("doc_id")).alias("filename"), "detections", total.alias("total_detections"),
        (applied + F.coalesce("links", F.lit(0)) + F.coalesce("fields", F.lit(0))).alias("replacements_applied"), F.when(ok, checks).alias("validation"),
        F.when(ok, F.uuid()).alias("download_id"), timing.alias("timing_ms"), evaluation.alias("evaluation"), "detection_audit",
    )
    return held(response, "docx-responses")


def _evaluations(spark: SparkSession, judged: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, evaluation) as JSON of every document with ground truth; the registry, and so this loop, is as long as its caller wrote it."""
    out = spark.createDataFrame([], "doc_id string, evaluation string")
    for row in judged.collect():
        truth = ground_truth.read(spark, row["truth_path"]).withColumn("doc_id", F.lit(row["doc_id"]))
        predicted = found.where(F.col("doc_id") == row["doc_id"]).withColumn("pred_id", F.struct("paragraph_index", "start", "ord"))
        metrics = E.category_metrics(truth, predicted)
        each = metrics.agg(F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("entity_type")).alias("order"), F.struct(*metrics.columns).alias("m")))).alias("c")).select(F.transform("c", lambda c: c["m"]).alias("per_category"))
        whole = E.micro_macro(metrics).join(F.broadcast(E.error_maps(metrics))).join(F.broadcast(each))
        fields = [F.lit(True).alias("available"), F.lit("controlled").alias("document_type"), *whole.columns]
        out = out.unionByName(whole.select(F.lit(row["doc_id"]).alias("doc_id"), F.to_json(F.struct(*fields)).alias("evaluation")))
    return out


def response_json(responses: DataFrame) -> DataFrame:
    """(doc_id, response): the fields of RESPONSE of each processed file as JSON, the error's where it failed."""
    return responses.select("doc_id", F.when(F.col("http_status") == 200, F.to_json(F.struct(*RESPONSE))).otherwise(F.col("error")).alias("response"))


def write_responses(responses: DataFrame, path: str) -> None:
    """The batch's result as JSON lines."""
    response_json(responses).select("response").write.mode("overwrite").text(path)


def download_records(responses: DataFrame) -> DataFrame:
    return responses.where("http_status = 200").select("download_id", "path", F.col("filename").alias("file_name"), "created_at")
