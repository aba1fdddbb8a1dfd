"""Folders that all executors share, and versions inside them that count once they are whole."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Stages hold a text once a phrase and target, so their files take most of a run's disk.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local master, whose executors are the driver, gets a folder
    that goes when Python ends; any other master gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="mirrorset-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/mirrorset-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it has ended, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that write meanwhile leave no shuffle files behind; a run of many stages needs the disk of one."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _opened(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _opened(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none when there is no such folder."""
    files, place = _opened(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(place)] if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _opened(spark, path)
    files.delete(place, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder came to its end, by the mark that it leaves last."""
    return exists(spark, f"{path}/_SUCCESS")


VERSION = re.compile(r"v=(\d+)$")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions in a folder, also of those whose write did not end."""
    return sorted(int(m[1]) for name in names_in(spark, path) if (m := VERSION.match(name)))


def version_path(path: str, number: int) -> str:
    return f"{path}/v={number}"


def current_version(spark: SparkSession, path: str) -> int | None:
    """The latest version that was written to its end; readers never see another one."""
    return next((n for n in reversed(versions(spark, path)) if finished(spark, version_path(path, n))), None)


def next_version(spark: SparkSession, path: str) -> int:
    return max(versions(spark, path), default=0) + 1


def drop_older(spark: SparkSession, path: str, number: int) -> None:
    """Delete what came before a version and the whole one before it, which readers may still be reading."""
    kept = [n for n in versions(spark, path) if n < number and finished(spark, version_path(path, n))][-1:]
    for n in versions(spark, path):
        if n < number and n not in kept:
            remove(spark, version_path(path, n))
