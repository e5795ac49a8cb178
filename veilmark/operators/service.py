"""What surrounds redaction: downloads, information, errors, counts-only logs, reports and display forms."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS, VERSION, settings
from ..functions.patterns import CATEGORIES
from ..streaming.files import live

log = logging.getLogger("veilmark")

# Error titles and messages by status.
ERRORS = {
    400: ("Invalid document", "Please upload a valid .docx file."),
    404: ("Not found", "Download token invalid or expired."),
    413: ("File too large", "Document exceeds maximum allowed size."),
    422: ("Validation Error", "Invalid request format."),
    500: ("Processing Error", "An internal error occurred while processing the document. Please try again."),
}


def error_response(status: Column) -> Column:
    """JSON of error and message for a status; null where there is no error."""
    known = F.create_map(*[F.lit(x) for code, pair in ERRORS.items() for x in (code, pair[0])]), F.create_map(*[F.lit(x) for code, pair in ERRORS.items() for x in (code, pair[1])])
    title, message = (F.coalesce(m[status], F.lit(default)) for m, default in zip(known, ("Error", "An error occurred.")))
    return F.when(status >= 400, F.to_json(F.struct(title.alias("error"), message.alias("message"))))


def service_info(spark: SparkSession) -> DataFrame:
    """One row: name, version, supported file type and the categories in display order."""
    return spark.createDataFrame([(settings(spark).app_name, VERSION, EXTENSIONS[0], CATEGORIES)], "name string, version string, supported_file_type string, pii_categories array<string>")


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok", VERSION)], "status string, version string")


def with_tokens(rows: DataFrame) -> DataFrame:
    """rows with a random download token each; staged by the caller, since tokens are drawn anew whenever the plan runs."""
    return rows.withColumn("download_id", F.uuid())


def token_format(token: Column) -> Column:
    return F.coalesce(F.lower(token).rlike(r"^[a-f0-9\-]{36}$"), F.lit(False))


def download(requests: DataFrame, records: DataFrame, now: str, ttl_seconds: int = 600) -> DataFrame:
    """requests(download_id) with status, file and name: 200 for a live token of the right form, else 404.

    records has download_id, path, file_name and created_at; only the live ones are looked up.
    """
    kept = live(records, now, ttl_seconds).select("download_id", "path", "file_name")
    both = requests.join(kept, "download_id", "left")
    found = token_format(F.col("download_id")) & F.col("path").isNotNull()
    return both.select("download_id", F.when(found, 200).otherwise(404).alias("status"), F.when(found, F.col("path")).alias("path"), F.when(found, F.col("file_name")).alias("file_name"))


def log_counts(counts: DataFrame) -> str:
    """Log and return counts by category (at most nine rows) and nothing else: no text ever reaches the log."""
    line = ", ".join(f"{r[0]}={r[1]}" for r in sorted(counts.collect()))
    log.info("detections by category: %s", line)
    return line


def display_category(name: Column) -> Column:
    return F.initcap(F.lower(F.replace(name, F.lit("_"), F.lit(" "))))


def display_percent(share: Column) -> Column:
    return F.when(share.isNull(), "N/A").otherwise(F.concat(F.format_string("%.1f", share * 100), F.lit("%")))


def display_bytes(size: Column) -> Column:
    """The largest unit of 1024 that fits, with at most one decimal; whole numbers have none."""
    units = ["Bytes", "KB", "MB", "GB"]
    power = reduce(lambda out, k: F.when(size >= 1024**k, k).otherwise(out), range(1, len(units)), F.lit(0))
    amount = F.regexp_replace(F.format_string("%.1f", size / F.pow(F.lit(1024.0), power)), r"\.0$", "")
    return F.concat(amount, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), power + 1))


def evaluation_table(metrics: list[Row], overall: Row) -> str:
    """Markdown of metrics by category (at most nine rows) and of the micro and macro averages."""
    names = ["Category", "Ground truth", "Predicted", "TP", "FP", "FN", "Precision", "Recall", "F1", "Exact span match ratio"]
    lines = ["| " + " | ".join(names) + " |", "| :--- |" + " ---: |" * 9]
    for r in sorted(metrics, key=lambda r: CATEGORIES.index(r["entity_type"])):
        lines.append(f"| {r['entity_type']} | {r['gt']} | {r['pred']} | {r['tp']} | {r['fp']} | {r['fn']} | {r['precision']:.4f} | {r['recall']:.4f} | {r['f1']:.4f} | {r['exact_match_ratio']:.4f} |")
    lines += ["", f"Micro averages: precision {overall['precision']:.4f}, recall {overall['recall']:.4f}, F1 {overall['f1']:.4f}, exact span match ratio {overall['exact_match_ratio']:.4f}"]
    return "\n".join([*lines, f"Macro averages: precision {overall['macro_precision']:.4f}, recall {overall['macro_recall']:.4f}, F1 {overall['macro_f1']:.4f}"])


def evaluation_report(document: str, metrics: DataFrame, overall: DataFrame, seconds: float) -> str:
    """A Markdown report on the evaluation of one document; numbers only, never the text."""
    total = overall.first()
    head = [f"# Evaluation of `{document}`", "", "A prediction counts where paragraph, start, end and category are those of an annotation; each side is used once.", ""]
    head += [f"* {name}: {total[column]}" for name, column in (("Annotated spans", "gt"), ("Predicted spans", "pred"), ("True positives", "tp"), ("False positives", "fp"), ("False negatives", "fn"))]
    return "\n".join([*head, f"* Seconds: {seconds:.2f}", "", "Macro averages are over the categories that occur on either side.", "", evaluation_table(metrics.collect(), total), ""])


def structure_report(counts: Row, file_name: str, size: int) -> str:
    """Plain text of a document's structural counts, without any of its text."""
    return "\n".join([f"File: {file_name}", f"Size: {size} bytes ({size / 1024:.2f} KB)", *(f"{name.capitalize()}: {counts[name]}" for name in counts.__fields__ if name != "doc_id")])
