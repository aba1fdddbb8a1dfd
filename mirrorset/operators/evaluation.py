"""Scores of few-shot predictions: macro P/R/F1, accuracy, prefixes, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import BUCKET_ROWS, earlier, pinned

RUN_KEYS = ("seed", "shots")
NO_CLASS = "\x00no prediction"


def confusion(predictions: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Counts per (truth, prediction)."""
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _class_events(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two rows per prediction: one for the true class, one for the predicted."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), hit.alias("tp"), one.alias("truth"), zero.alias("pred")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("tp"), zero.alias("truth"), one.alias("pred")),
    )
    return predictions.select(*keys, F.inline(sides))


def class_counts(
    predictions: DataFrame, keys: Sequence[str] = RUN_KEYS, flags: Sequence[str] = ()
) -> DataFrame:
    """Hits, true rows and predicted rows per class seen on either side.

    One shuffle of partial sums; no join of truth and prediction counts. ``flags`` are
    columns that are true for a group if they are for one of its rows.
    """
    return _class_events(predictions, [*keys, *flags]).groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"),
        F.sum("truth").alias("truth"),
        F.sum("pred").alias("pred"),
        *(F.max(f).alias(f) for f in flags),
    )


def _scores(tp: Column, truth: Column, pred: Column) -> dict[str, Column]:
    """Per-class scores with 0 for an empty denominator."""
    zero = F.lit(0.0)
    return {
        "precision": F.when(pred > 0, tp / pred).otherwise(zero),
        "recall": F.when(truth > 0, tp / truth).otherwise(zero),
        "fscore": F.when(truth + pred > 0, 2 * tp / (truth + pred)).otherwise(zero),
    }


def macro_prf(predictions: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Macro scores over every class seen in truth or prediction, and accuracy.

    A free-text prediction is a class of its own. Macro F1 is the mean of the
    per-class F1.
    """
    counts = class_counts(predictions, keys)
    scores = _scores(F.col("tp"), F.col("truth"), F.col("pred"))
    return counts.groupBy(*keys).agg(
        *(F.avg(value).alias(name) for name, value in scores.items()),
        (F.sum("tp") / F.sum("truth")).alias("accuracy"),
        F.sum("truth").alias("test_size"),
    )


def out_of_domain(
    predictions: DataFrame, masked_labels: DataFrame, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Share of predictions that name no known label."""
    known = masked_labels.select(F.col("masked").alias("y_pred"), F.lit(True).alias("_known"))
    joined = predictions.join(pinned(known), "y_pred", "left")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_known").isNull()).alias("n_unknown")
    )


def prefix_metrics(
    predictions: DataFrame,
    every: int = 25,
    keys: Sequence[str] = RUN_KEYS,
    ord_col: str = "ord",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The macro scores after every ``every`` test rows.

    ``ord`` counts all test rows from 0, also those without a prediction; a
    checkpoint exists where the row that completes it has one. The counts of a
    class change only in checkpoints that see the class, so each (class,
    checkpoint) adds the change of its scores and the changes are summed along
    the checkpoints. Work grows with the rows, not with rows times checkpoints.
    """
    keys = list(keys)
    numbered = predictions.withColumn("chunk", F.floor(F.col(ord_col) / every)).withColumn(
        "closes", (F.col(ord_col) + 1) % every == 0
    )
    # no prediction is a class of its own, as in macro_prf; keys of a running sum must not be null
    events = class_counts(numbered, [*keys, "chunk"], ["closes"])
    events = events.withColumn("class", F.coalesce("class", F.lit(NO_CLASS)))
    before = earlier(
        events,
        "chunk",
        {f"b_{c}": ("sum", F.col(c)) for c in ("tp", "truth", "pred")},
        [*keys, "class"],
        bucket_rows,
    ).select("*", *(F.coalesce(f"b_{c}", F.lit(0)).alias(f"o_{c}") for c in ("tp", "truth", "pred")))

    old = _scores(F.col("o_tp"), F.col("o_truth"), F.col("o_pred"))
    new = _scores(*(F.col(f"o_{c}") + F.col(c) for c in ("tp", "truth", "pred")))
    is_new_class = (F.col("b_truth").isNull()).cast("bigint")
    changes = before.groupBy(*keys, "chunk").agg(
        *(F.sum(new[s] - old[s]).alias(f"d_{s}") for s in old),
        F.sum(is_new_class).alias("d_classes"),
        F.sum("tp").alias("d_tp"),
        F.sum("truth").alias("d_rows"),
        F.max("closes").alias("closes"),
    )
    sums = ["precision", "recall", "fscore", "classes", "tp", "rows"]
    totals = earlier(
        changes,
        "chunk",
        {f"s_{s}": ("sum", F.col(f"d_{s}")) for s in sums},
        keys,
        bucket_rows,
        inclusive=True,
    )
    return totals.filter("closes").select(
        *keys,
        ((F.col("chunk") + 1) * every).alias("checkpoint"),
        *((F.col(f"s_{s}") / F.col("s_classes")).alias(s) for s in ("precision", "recall", "fscore")),
        (F.col("s_tp") / F.col("s_rows")).alias("accuracy"),
        F.col("s_rows").alias("test_size"),
    )


def final_metrics(metrics: DataFrame, keys: Sequence[str] = ("seed",)) -> DataFrame:
    """The row of the largest shot size per seed."""
    rest = [c for c in metrics.columns if c not in keys]
    best = F.max_by(F.struct(*rest), "shots").alias("_best")
    return metrics.groupBy(*keys).agg(best).select(*keys, *(f"_best.{c}" for c in rest))


def seed_summary(metrics: DataFrame, keys: Sequence[str] = ("shots",)) -> DataFrame:
    """Mean and population standard deviation of the scores over seeds."""
    scores = ("precision", "recall", "fscore", "accuracy")
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        *(F.avg(s).alias(f"{s}_mean") for s in scores),
        *(F.stddev_pop(s).alias(f"{s}_std") for s in scores),
    )
