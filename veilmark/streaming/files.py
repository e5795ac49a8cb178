"""Streams: documents arriving as files, and expiry of download tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect


def detect_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "doc_id long, paragraph_index int, text string") -> StreamingQuery:
    """Detections of paragraphs that arrive as JSON files; detection keeps no state, so each file is read once."""
    return detect(spark.readStream.schema(schema).json(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(records: DataFrame, now, ttl_seconds: int = 600) -> DataFrame:
    """Records whose created_at is at most ttl_seconds before now."""
    return records.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at") <= ttl_seconds)
