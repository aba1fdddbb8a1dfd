"""Stage tables: parquet by run, in versions that readers see once they are whole, and answers by request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import folders
from .answers import AnswerStore
from .folders import CODEC, shared_folder  # noqa: F401

# Partition columns; prefixed, as tables of scores have a seed column of their own.
RUN = ("run_seed", "run_model", "run_dataset")


def _path(root: str, stage: str) -> str:
    return f"{root.rstrip('/')}/{stage}"


def slug_name(name: str) -> str:
    """The run-key rule of ``functions.text.slug`` for a plain string."""
    return "".join("_" if sign in ":/.-" else sign for sign in name)


def _run_path(root: str, stage: str, seed: int, model: str, dataset: str) -> str:
    values = zip(RUN, (seed, slug_name(model), slug_name(dataset)))
    return "/".join([_path(root, stage), *(f"{column}={value}" for column, value in values)])


def write_stage(df: DataFrame, root: str, stage: str, seed: int, model: str, dataset: str) -> None:
    """Replace one run of a stage; other runs of the table stay.

    The run is written as a new version. Until its write has come to an end, readers get the
    version before, also when the write fails; so a run may be made out of its own last version.
    An empty result keeps its schema. The version before the last is deleted.
    """
    spark, path = df.sparkSession, _run_path(root, stage, seed, model, dataset)
    number = folders.next_version(spark, path)
    with folders.shuffles_deleted(spark):
        df.write.option("compression", CODEC).parquet(folders.version_path(path, number))
    folders.drop_older(spark, path, number)


def read_stage(
    spark: SparkSession, root: str, stage: str, seed: int, model: str, dataset: str
) -> DataFrame:
    """One run of a stage table; fails when that run was never written."""
    path = _run_path(root, stage, seed, model, dataset)
    number = folders.current_version(spark, path)
    return spark.read.parquet(folders.version_path(path, number) if number else path)


def drop_stage(spark: SparkSession, root: str, stage: str, seed: int, model: str, dataset: str) -> None:
    """Delete one run of a stage that nothing reads any more."""
    folders.remove(spark, _run_path(root, stage, seed, model, dataset))


def read_runs(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """All runs of a stage, told apart by the partition columns in ``RUN``."""
    runs = [_path(root, stage)]
    for column in RUN:
        runs = [f"{run}/{name}" for run in runs for name in folders.names_in(spark, run) if name.startswith(f"{column}=")]
    found = [(run, folders.current_version(spark, run)) for run in runs]
    whole = [folders.version_path(run, number) for run, number in found if number]
    return spark.read.option("basePath", _path(root, stage)).parquet(*whole).drop("v")


def has_stage(spark: SparkSession, root: str, stage: str, seed: int, model: str, dataset: str) -> bool:
    """Whether a run of a stage was written to its end."""
    return folders.current_version(spark, _run_path(root, stage, seed, model, dataset)) is not None


def answer_store(spark: SparkSession, root: str, stage: str) -> AnswerStore:
    """The stored answers of a stage."""
    return AnswerStore(spark, _path(root, stage))


def append_results(answers: DataFrame, root: str, stage: str, run: int = 0) -> None:
    """Add answers to a progress table; earlier ones are never rewritten."""
    answer_store(answers.sparkSession, root, stage).append(answers, run)


def has_results(spark: SparkSession, root: str, stage: str) -> bool:
    """Whether answers were appended; folders without a finished append count as none."""
    return answer_store(spark, root, stage).exists()


def read_results(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """Stored answers, one per request however often it was written."""
    return answer_store(spark, root, stage).read()
