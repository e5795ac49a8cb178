"""Helpers shared by the corpus operators: shared scratch tables, id semi-joins, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids and other short rows are broadcast up to this many (8 to 24 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000

#: Rows of an Arrow batch while a table is staged.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="veilmark-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _short_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS while a table is written: whole texts make long rows, held in the JVM and in Python at once."""
    before = spark.conf.get(_BATCH)
    if int(before) > BATCH_ROWS or int(before) <= 0:
        spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def discard(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Delete staged tables (or scratch paths) that nothing reads any more."""
    for table in tables:
        if path := table if isinstance(table, str) else getattr(table, "_scratch_path", None):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_RESIDENT: dict = {}
_LIBC = ctypes.CDLL(None)


def _give_back() -> None:
    """Return freed memory of a Python worker to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def resident(key: object, make: Callable[[], object]):
    """What a Python worker keeps from batch to batch; an operator's object drops that of the operator before, and its memory goes back."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            gc.collect()
            _give_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


class Remembered:
    """Answers of a Python worker by word, bounded by bytes; what is forgotten is asked for again, so results don't depend on it.

    Once half full, a word is kept from its second sighting on (a table of marks remembers the first, and may take one word for
    another, which only keeps a word early); words over LONGEST characters are not kept. Beyond the bound the older half goes.
    """

    LONGEST = 256

    def __init__(self, limit: int = 36_000_000, marks: int = 1 << 22, entry: int = 180, letter: int = 6):
        """entry and letter: bytes of a key, its value and their place, fixed and for each character."""
        self.known: dict = {}
        self.entry, self.letter = entry, letter
        self.limit, self.size, self.marks, self.first = limit, 0, bytearray(marks), 0

    def _bytes(self) -> int:
        return self.entry * len(self.known) + self.letter * sum(map(len, self.known))

    def keep(self, found: dict) -> None:
        """Keep the answers of found that were met before."""
        known, marks, mask, before, letters, open_ = self.known, self.marks, len(self.marks) - 1, len(self.known), 0, 2 * self.size < self.limit
        for word, answer in found.items():
            at = hash(word) & mask
            if not marks[at] and not open_:
                marks[at] = 1
            elif len(word) <= self.LONGEST:
                known[word] = answer
                letters += len(word)
        self.first += len(found) - len(known) + before
        self.size += self.entry * (len(known) - before) + self.letter * letters
        if self.first > len(marks) // 4:
            self.marks, self.first = bytearray(len(marks)), 0
        if self.size > self.limit:
            newer = list(known.items())[len(known) // 2 :]
            known.clear()
            known.update(newer)
            self.size = self._bytes()


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A staged table of short rows as one side of a join: broadcast up to BROADCAST_ROWS, shuffled beyond."""
    rows = table.count() if rows is None else rows
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Rows of df whose key is in ids (a staged table)."""
    return df.join(small(ids, rows), key, "left_semi")


def arrow_map(df: DataFrame, rows: Callable[[dict], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow over dicts of lists: rows(columns) returns the output columns of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(1_000_000, 50, 1000)  # the workers' remembered words are no cycles, but are walked each time
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        _give_back()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
