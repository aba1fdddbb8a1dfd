"""Budgets, failure rules and resume by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import is_quota_error
from ..functions.text import TOKENS_A_WORD, WORD, token_estimate, word_count
from .order import BUCKET_ROWS, earlier

def within_budget(
    calls: DataFrame,
    tokens: str = "tokens",
    *,
    limit: int,
    example: str = "ord",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Examples whose predecessors together cost no more than ``limit``.

    One row per example with its own tokens and those before it. The example
    that crosses the limit is still kept whole.
    """
    each = calls.groupBy(example).agg(F.sum(tokens).alias("tokens"))
    spent = earlier(each, example, {"spent": ("sum", F.col("tokens"))}, bucket_rows=bucket_rows)
    spent = spent.withColumn("spent", F.coalesce("spent", F.lit(0)))
    return spent.filter(F.col("spent") <= limit)


def left_out(calls: DataFrame, kept: DataFrame, example: str = "ord") -> DataFrame:
    """How many examples a budget keeps and how many it leaves out: one row."""
    within = kept.select(example, F.lit(True).alias("_kept"))
    each = calls.select(example).distinct().join(within, example, "left")
    return each.agg(
        F.count_if(F.col("_kept")).alias("n_kept"), F.count_if(F.col("_kept").isNull()).alias("n_left_out")
    )


def stop_on_failures(
    results: DataFrame,
    max_consecutive: int = 5,
    ord_col: str = "ord",
    error: str = "error",
    bucket_rows: int = BUCKET_ROWS,
    carried: int = 0,
) -> DataFrame:
    """Rows before the run would have stopped.

    The run stops at the ``max_consecutive``-th failure in a row, or at a quota
    error; that row and all later ones are left out. ``ord_col`` must be dense.
    ``carried`` failures in a row came right before the first row.
    """
    calls = results.select(ord_col, error)
    failed, quota = calls.agg(
        F.count_if(F.col(error).isNotNull()), F.min(F.when(is_quota_error(F.col(error)), F.col(ord_col)))
    ).first()
    # calls are walked only where so many failed that they could be in a row; the stop is looked for once, however often rows are read
    cut = quota
    if failed + carried >= max_consecutive:
        ok = F.when(F.col(error).isNull(), F.col(ord_col))
        walked = earlier(
            calls, ord_col, {"last_ok": ("max", ok)}, bucket_rows=bucket_rows, inclusive=True
        )
        start = calls.agg((F.min(ord_col) - 1 - carried).alias("v")).scalar()
        streak = F.col(ord_col) - F.coalesce("last_ok", start)
        stops = walked.filter((streak >= max_consecutive) | is_quota_error(F.col(error)))
        cut = stops.agg(F.min(ord_col)).first()[0]
    return results if cut is None else results.filter(F.col(ord_col) < cut)


def streak_after(results: DataFrame, ord_col: str, carried: int = 0, error: str = "error") -> int:
    """Failures in a row at the end of calls, given how many came right before them."""
    ok = F.max(F.when(F.col(error).isNull(), F.col(ord_col)))
    n, last, last_ok = results.agg(F.count(F.lit(1)), F.max(ord_col), ok).first()
    return carried + n if last_ok is None else last - last_ok


def apply_failure_default(df: DataFrame, stage: str, error: str = "error") -> DataFrame:
    """What a stage stores for a failed call, or the rows without it.

    Generation stores an empty rewrite, the gates their failing verdicts; pattern
    batches, candidate lists and predictions of failed calls are dropped.
    """
    failed = F.col(error).isNotNull()
    if stage == "generation":
        return df.withColumn("counterfactual", F.when(failed, F.lit("")).otherwise(F.col("counterfactual")))
    if stage == "semantic":
        return df.withColumn(
            "matched_pattern", F.when(failed, F.lit(False)).otherwise(F.col("matched_pattern"))
        )
    if stage == "discriminator":
        return df.withColumn("is_ori", F.when(failed, F.lit(True)).otherwise(F.col("is_ori"))).withColumn(
            "is_target", F.when(failed, F.lit(False)).otherwise(F.col("is_target"))
        )
    if stage in ("pattern", "candidates", "scoring"):
        return df.filter(~failed)
    raise ValueError(f"unknown stage: {stage}")


def pending(requests: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Requests without a stored answer; failed ones again on demand."""
    if retry_failed:
        done = done.filter(F.col("error").isNull())
    return requests.join(done.select("request_id"), "request_id", "left_anti")


def resume_merge(done: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new answers, one per request: an answer beats an error, then the stored one."""
    both = done.select("request_id", "text", "error", F.lit(0).alias("_run")).unionByName(
        new.select("request_id", "text", "error", F.lit(1).alias("_run"))
    )
    return one_answer(both, "_run")


def one_answer(answers: DataFrame, run: str, keep_run: bool = False) -> DataFrame:
    """One answer per request out of several runs; the text breaks the last tie."""
    order = F.struct(F.col("error").isNotNull(), F.col(run), F.col("text"), F.col("error"))
    kept = ["text", "error", *([run] if keep_run else [])]
    best = F.min_by(F.struct(*kept), order).alias("_best")
    return answers.groupBy("request_id").agg(best).select("request_id", *(f"_best.{c}" for c in kept))


def error_classes(results: DataFrame, error: str = "error", keys: Sequence[str] = ()) -> DataFrame:
    """Calls by outcome: ok, quota or other failure."""
    kind = (
        F.when(F.col(error).isNull(), F.lit("ok"))
        .when(is_quota_error(F.col(error)), F.lit("quota"))
        .otherwise(F.lit("failed"))
    )
    return results.groupBy(*keys, kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n_calls"))


def _prompt(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), " ")


def call_tokens(messages: Column, reply: Column) -> Column:
    """Estimated tokens of a call: all message texts joined by spaces, reply appended."""
    return token_estimate(F.concat(_prompt(messages), F.coalesce(reply, F.lit(""))))


def prompt_words(messages: Column) -> tuple[Column, Column]:
    """Words of the message texts, and whether the last one goes on in a reply that begins with a word."""
    prompt = _prompt(messages)
    return word_count(prompt), F.right(prompt, F.lit(1)).rlike(WORD)


def said_tokens(words: Column, open_: Column, reply: Column) -> Column:
    """``call_tokens`` of a call whose prompt is known by its ``prompt_words`` only."""
    reply = F.coalesce(reply, F.lit(""))
    shared = F.when(open_ & F.left(reply, F.lit(1)).rlike(WORD), 1).otherwise(0)
    return F.floor((words + word_count(reply) - shared) * F.lit(TOKENS_A_WORD))


def longest_reply(max_tokens: Column) -> Column:
    """Estimated tokens that a reply of the greatest length adds to its call at most."""
    return F.ceil(max_tokens * TOKENS_A_WORD) + 1


def token_usage(calls: DataFrame, tokens: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Calls and tokens per key; over the whole run without keys."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum(tokens).alias("tokens")
    )
