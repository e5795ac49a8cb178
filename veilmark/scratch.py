"""Intermediate tables of one query, written once and read again, so that detection runs once however often its result is used."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; with a local master and none set, a temporary one."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="veilmark-core-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def held(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back; lost executors repeat the reading only."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
