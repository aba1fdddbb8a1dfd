"""The three gates on rewritten sentences and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_two_answers, parse_yes_no
from ..functions.text import META_PHRASES, heuristic_ok
from .order import beside
from .requests import ROW_KEYS


def heuristic_gate(df: DataFrame, phrases: tuple[str, str] = META_PHRASES) -> DataFrame:
    """Adds ``heuristic_filtered``; an empty rewrite counts as missing."""
    text = F.nullif("counterfactual", F.lit(""))
    return df.withColumn("heuristic_filtered", heuristic_ok(text, phrases))


def semantic_verdicts(responses: DataFrame) -> DataFrame:
    """Yes/no replies as ``matched_pattern``; a failed call counts as no."""
    failed = F.col("error").isNotNull() | F.col("text").isNull()
    return responses.withColumn(
        "matched_pattern", F.when(failed, F.lit(False)).otherwise(parse_yes_no(F.col("text")))
    )


def discriminator_verdicts(responses: DataFrame) -> DataFrame:
    """Two-word replies as ``is_ori``, ``is_target``; a failed call gives (true, false)."""
    failed = F.col("error").isNotNull() | F.col("text").isNull()
    answers = responses.withColumn("_answers", parse_two_answers(F.col("text")))
    return answers.withColumn(
        "is_ori", F.when(failed, F.lit(True)).otherwise(F.col("_answers.is_ori"))
    ).withColumn(
        "is_target", F.when(failed, F.lit(False)).otherwise(F.col("_answers.is_target"))
    ).drop("_answers")


def overlay(
    df: DataFrame, saved: DataFrame, columns: Sequence[str], keys: Sequence[str] = ROW_KEYS
) -> DataFrame:
    """Lay saved verdicts over a table by key; rows without one keep their value or null.

    ``saved`` holds at most one row per key. Rows are dealt out by the first key.
    """
    renamed = saved.select(*keys, *(F.col(c).alias(f"_saved_{c}") for c in columns)).dropna(subset=list(keys))
    joined = beside(df, renamed, list(keys), keys[0])
    for c in columns:
        kept = F.coalesce(f"_saved_{c}", c) if c in df.columns else F.col(f"_saved_{c}")
        joined = joined.withColumn(c, kept)
    return joined.drop(*(f"_saved_{c}" for c in columns))


def accepted() -> Column:
    """Rows through all gates; null verdicts do not pass."""
    return F.col("heuristic_filtered") & F.col("matched_pattern") & ~F.col("is_ori") & F.col("is_target")


def verdict() -> Column:
    """``pass`` for (not original, target), ``partial`` for one of both, else ``fail``."""
    left, reached = ~F.col("is_ori"), F.col("is_target")
    return (
        F.when(left & reached, F.lit("pass"))
        .when(left | reached, F.lit("partial"))
        .when(F.col("is_ori").isNotNull(), F.lit("fail"))
    )


def export_fine_tune(filtered: DataFrame) -> DataFrame:
    """Training rows: accepted rewrites under their export names."""
    return filtered.filter(accepted()).select(
        "id",
        "ori_text",
        "ori_label",
        "pattern",
        F.col("counterfactual").alias("counter_text"),
        F.col("target_label").alias("counter_label"),
    )


def augment(train: DataFrame, fine_tune: DataFrame) -> DataFrame:
    """Training set of originals and accepted rewrites, with where each row is from."""
    originals = train.select("id", "text", "label", F.lit("original").alias("origin"))
    rewrites = fine_tune.select(
        "id",
        F.col("counter_text").alias("text"),
        F.col("counter_label").alias("label"),
        F.lit("counterfactual").alias("origin"),
    )
    return originals.unionByName(rewrites)


def rate(part: Column, whole: Column) -> Column:
    """A share, 0 when the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def pass_rates(filtered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Passed, total and rate of the first two gates in one pass.

    The total of a gate is the rows that reached it.
    """
    counts = filtered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("heuristic_filtered")).alias("n_heuristic"),
        F.count_if(F.col("matched_pattern")).alias("n_matched"),
    )
    return counts.select(
        "*",
        rate(F.col("n_heuristic"), F.col("n_rows")).alias("heuristic_rate"),
        rate(F.col("n_matched"), F.col("n_heuristic")).alias("matched_rate"),
    )


def discriminator_rates(filtered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Not-original, is-target and both, over the rows that reached the last gate."""
    reached = F.col("heuristic_filtered") & F.col("matched_pattern")
    left, target = ~F.col("is_ori"), F.col("is_target")
    counts = filtered.groupBy(*keys).agg(
        F.count_if(reached).alias("n_reached"),
        F.count_if(left).alias("n_not_ori"),
        F.count_if(target).alias("n_target"),
        F.count_if(left & target).alias("n_both"),
    )
    return counts.select(
        "*",
        rate(F.col("n_not_ori"), F.col("n_reached")).alias("not_ori_rate"),
        rate(F.col("n_target"), F.col("n_reached")).alias("target_rate"),
    )
