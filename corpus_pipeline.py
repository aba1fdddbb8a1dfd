"""From documents to token sequences: language, near duplicates, repeats, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept.
Stages are written as Parquet in the shared folder and read again. All but the last return
the columns of ``documents``. When a stage begins, the tables that the one before it wrote for
itself are deleted, as its result has been written by then; tables that ``docs`` still reads stay.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.llm import jaccard, language, packing, secrets, suffixes
from mirrorset.llm.queries import table
from mirrorset.llm.staging import discard, recorded, staged

#: A document is rejected if its best language is less probable than this, or than this many times chance with many languages.
LEAST_SCORE, LEAST_OVER_CHANCE = 0.3, 1.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that the network finds a language for; without a label to learn from, all with letters.

    Null and empty texts go, repeated rows stay together, and an empty table gives an empty one.
    """
    net = language.trained_on(docs)
    if net is None:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    least = min(LEAST_SCORE, LEAST_OVER_CHANCE / len(net.labels))
    found = language.identify(docs, net)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select(docs.columns)


def one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group of near duplicates; texts without words are alike to nothing and stay."""
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat earlier matches of 100; null texts stay null, repeated rows lose theirs."""
    return suffixes.without_repeats(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets and linked credentials masked; null texts stay null."""
    return secrets.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence of at most 4096 tokens; null texts are the end id alone."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.piece_digest(packing.pack_documents(docs.select("doc_id", "text"), tokenizer, end_id=1, capacity=4096, lean=True))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that finished stages wrote for themselves.
_left: list[str] = []


def tidied(stage: Stage) -> Stage:
    """A stage that deletes what the stages before it have left."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        for path in [*_left]:
            name = path.rsplit("/", 1)[1]
            if not any(f"/{name}/" in file for file in read):
                discard(spark, path)
                _left.remove(path)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language", tidied(known_language)),
    ("near_duplicates", tidied(one_of_alike)),
    ("repeats", tidied(without_repeats)),
    ("secrets", tidied(without_secrets)),
    ("packing", tidied(sequences)),
]

#: Model, joins and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
