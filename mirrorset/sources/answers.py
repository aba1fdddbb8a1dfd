"""Answers of model calls: a store in buckets of request ids, and a log that tasks write ahead of it.

A call costs money, so what it answered must not be lost. While a task runs, it adds its answers to
files of its own in the log, a few calls at a time. When the task is tried again it hands on what
its log holds and calls the model for the rest only. When the whole job is lost, the next run takes
the logs into the store first.

The store is a table bucketed by request id. Joining requests to it, or looking for requests
without an answer, moves the requests only: the stored side is read bucket by bucket. Runs add
files to the buckets; when these pile up, a new version with one file a bucket and one answer a
request takes their place.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runcontrol import one_answer
from . import folders

SCHEMA = "request_id STRING, text STRING, error STRING, run INT"
ANSWER = pa.schema([("request_id", pa.string()), ("text", pa.string()), ("error", pa.string())])
#: Files a bucket may have before they are merged.
PILE = 8


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class AnswerLog:
    """Where the tasks of one model step log their answers.

    At most ``flush_calls`` answers, or those of the last ``flush_seconds``, are lost with a
    machine; none with an exception. The folder must be one that Python reaches on executors
    (a path, or a URI that pyarrow knows).
    """

    path: str
    flush_calls: int = 50
    flush_seconds: float = 10.0

    def of_task(self, partition: int) -> TaskLog:
        return TaskLog(self, partition)


class TaskLog:
    """The log of one task: what earlier tries of it answered, and what this one adds."""

    def __init__(self, log: AnswerLog, partition: int):
        self.log = log
        self.files, root = _file_system(log.path)
        self.folder = f"{root}/p{partition:06d}"
        self.rows: list[tuple[str, str | None, str | None]] = []
        self.since = time.monotonic()

    def earlier(self) -> Iterator[pa.Table]:
        """Answers of earlier tries, a file at a time."""
        found = self.files.get_file_info(pa.fs.FileSelector(self.folder, allow_not_found=True))
        for entry in sorted(found, key=lambda e: e.path):
            if entry.base_name.startswith("a-"):
                with self.files.open_input_file(entry.path) as source:
                    yield pa.parquet.read_table(source, schema=ANSWER)

    def add(self, request_id: str, text: str | None, error: str | None) -> None:
        self.rows.append((request_id, text, error))
        if len(self.rows) >= self.log.flush_calls or time.monotonic() - self.since >= self.log.flush_seconds:
            self.flush()

    def flush(self) -> None:
        """Write what was added; the file appears under its name when it is whole."""
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), ANSWER)]
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.parquet"
            self.files.create_dir(self.folder, recursive=True)
            with self.files.open_output_stream(f"{self.folder}/_{name}") as sink:
                pa.parquet.write_table(pa.Table.from_arrays(columns, schema=ANSWER), sink)
            self.files.move(f"{self.folder}/_{name}", f"{self.folder}/a-{name}")
            self.rows = []
        self.since = time.monotonic()


class AnswerStore:
    """Answers under a folder, bucketed by request id.

    A new store has ``buckets`` buckets, as many as shuffles have partitions by default; later appends
    and versions keep that number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- versions --

    def _current(self) -> tuple[int, int] | None:
        """(version, buckets) of the answers that count."""
        made = folders.current_version(self.spark, self.path)
        if made is None:
            return None
        sizes = [n for n in folders.names_in(self.spark, f"{self.path}/sizes") if n.startswith(f"{made}-")]
        return made, int(sizes[0].split("-")[1])

    def _table(self, version: int, buckets: int, use: str) -> str:
        """A catalog name for the bucketed files; what reads and what adds have one each."""
        folder = folders.version_path(self.path, version)
        name = f"mirrorset_{use}_{hashlib.md5(folder.encode()).hexdigest()}"
        quoted = folder.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet OPTIONS (compression '{folders.CODEC}') "
            f"CLUSTERED BY (request_id) SORTED BY (request_id) INTO {buckets} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def _write(self, answers: DataFrame, version: int, buckets: int, dealt: bool = False) -> None:
        """Add rows to a version; ``dealt`` ones come from the buckets of another one and need no shuffle."""
        rows = answers.select("request_id", "text", "error", F.col("run").cast("int"))
        rows = rows if dealt else rows.repartition(buckets, "request_id").sortWithinPartitions("request_id")
        table = self._table(version, buckets, "add")
        with folders.shuffles_deleted(self.spark):
            rows.write.insertInto(table)

    def _create(self, answers: DataFrame, buckets: int, dealt: bool = False) -> int:
        version = folders.next_version(self.spark, self.path)
        # the bucket count of a version is there before the version is
        files, place = folders._opened(self.spark, f"{self.path}/sizes/{version}-{buckets}")
        files.create(place).close()
        self._write(answers, version, buckets, dealt)
        return version

    # -- use --

    def exists(self) -> bool:
        return self._current() is not None

    def log_rows(self) -> DataFrame:
        """All stored rows, one per answer that was given."""
        current = self._current()
        if current is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.table(self._table(*current, "read"))

    def read(self) -> DataFrame:
        """One answer per request, without a shuffle.

        Texts are grouped only if some request has several answers; that is found out from the ids alone.
        """
        stored = self.log_rows()
        several = stored.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if several.take(1):
            return one_answer(stored, "run")
        return stored.select("request_id", "text", "error")

    def append(self, answers: DataFrame, run: int = 0) -> None:
        """Add answers; earlier ones are never rewritten."""
        rows = answers.select("request_id", "text", "error", F.lit(run).alias("run"))
        current = self._current()
        if current is None:
            self._create(rows, self.buckets)
        else:
            self._write(rows, *current)

    def pile(self) -> int:
        """Files of the fullest bucket."""
        version, _ = self._current()
        names = folders.names_in(self.spark, folders.version_path(self.path, version))
        held: dict[str, int] = {}
        for name in names:
            if name.startswith("part-"):
                bucket = name.split(".")[0].rsplit("_", 1)[1]
                held[bucket] = held.get(bucket, 0) + 1
        return max(held.values(), default=0)

    def compact(self, pile: int = PILE) -> bool:
        """Merge the files of each bucket if one has ``pile`` of them; readers go on with the version they have."""
        current = self._current()
        if current is None or self.pile() < pile:
            return False
        best = one_answer(self.log_rows(), "run", keep_run=True)
        folders.drop_older(self.spark, self.path, self._create(best, current[1], dealt=True))
        return True

    # -- the log ahead of the store --

    def log(self, flush_calls: int = 50, flush_seconds: float = 10.0) -> AnswerLog:
        return AnswerLog(f"{self.path}/log", flush_calls, flush_seconds)

    def recover(self, run: int = 0) -> None:
        """Take in what tasks of a lost job have logged."""
        path = f"{self.path}/log"
        if not folders.names_in(self.spark, path):
            return
        schema = "request_id STRING, text STRING, error STRING"
        logged = self.spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "a-*").parquet(path)
        fresh = logged.dropDuplicates(["request_id"])
        known = self.log_rows().filter(F.col("run") == run).select("request_id")
        self.append(fresh.join(known, "request_id", "left_anti"), run)
        self.drop_log()

    def drop_log(self) -> None:
        """Forget the log of a step whose answers are stored."""
        folders.remove(self.spark, f"{self.path}/log")
