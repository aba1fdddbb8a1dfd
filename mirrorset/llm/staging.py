"""Shared stage folder, written tables, and byte-bounded batches for tasks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes of text that a numpy step works on at a time.
CHUNK_BYTES = 256 << 10


def stage_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of its own (tests); a cluster
    gets an error, because executors do not share local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mirrorset-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths that a recorded step has taken; None while nothing is recorded.
_TAKEN: list[str] | None = None


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{stage_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _TAKEN is not None:
        _TAKEN.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that are written meanwhile, so that they can be deleted once their reader is done."""
    global _TAKEN
    before, _TAKEN = _TAKEN, []
    try:
        yield _TAKEN
    finally:
        _TAKEN = before


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(frame: DataFrame, path: str, batch_bytes: int = 4 << 20) -> None:
    """Write a table; meanwhile Python workers get batches of about ``batch_bytes``."""
    spark = frame.sparkSession
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(batch_bytes))
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which also cuts its lineage."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    written(frame, path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds ``limit`` text bytes, or one longer row."""
    lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


_C = ctypes.CDLL(None)
#: Called to forget what a worker remembers for tasks of one kind.
FORGET: list[Callable[[], None]] = []


def release_memory() -> None:
    """Forget what earlier tasks of other kinds left in this worker, and give freed memory back to the system.

    Workers are used again and share the memory limit of their executor.
    """
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(rows: Rows) -> Rows:
    """A step over batches that begins and leaves its worker without memory it does not need."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        yield from rows(batches)
        release_memory()

    return wrapped


def planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that equal high bytes lie side by side and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def numbered(docs: DataFrame) -> DataFrame:
    """Add ``__doc``: unique numbers in order of doc_id. It is doc_id itself unless that repeats or is null."""
    counts = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if counts["rows"] == counts["ids"]:
        return docs.withColumn("__doc", F.col("doc_id").cast("long"))
    schema = StructType([*docs.schema.fields, StructField("__doc", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "__doc"])
            at += batch.num_rows

    ordered = docs.withColumn("__tie", F.xxhash64("text")).repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    return staged(ordered.mapInArrow(number, schema), "numbered")
