"""Seeded shuffles, samples, batches and first-row picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import shuffle_key, shuffled_rank

# Shot sizes.
DEFAULT_SHOTS = (10, 15, 30, 50, 70, 90, 120)


def seeded_shuffle(df: DataFrame, seed: int, row_id: str = "id") -> DataFrame:
    """Every row with its place ``rn`` in a repeatable shuffle."""
    return shuffled_rank(df, seed, row_id)


def sample_per_label(
    df: DataFrame, n: int | None = 50, seed: int = 42, label: str = "label", row_id: str = "id"
) -> DataFrame:
    """First ``n`` rows of the shuffle per label, all rows with ``n=None``."""
    return shuffled_rank(df.filter(F.col(label).isNotNull()), seed, row_id, [label], n)


def assign_batches(df: DataFrame, size: int = 20, rank: str = "rn") -> DataFrame:
    """``batch_no`` (0-based, per label) and ``pos`` (0-based) from the rank."""
    place = F.col(rank) - 1
    return df.withColumn("batch_no", F.floor(place / size)).withColumn("pos", place % size)


def collect_batches(batched: DataFrame, label: str = "label") -> DataFrame:
    """One row per batch with its examples in order, ``rows``; at most ``size`` each."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "text", "ord")))
    return batched.groupBy(label, "batch_no").agg(rows.alias("rows"))


def batch_text(rows: Column) -> Column:
    """The ``- text`` lines of a batch."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["text"])), "\n")


def first_per_id(df: DataFrame, row_id: str = "id", ord_col: str = "ord") -> DataFrame:
    """The row with the lowest ``ord`` of each id, by partial aggregation."""
    rest = [c for c in df.columns if c != row_id]
    first = F.min_by(F.struct(*rest), F.col(ord_col)).alias("_first")
    return df.groupBy(row_id).agg(first).select(row_id, *(f"_first.{c}" for c in rest))


def topn_per_id(df: DataFrame, n: int = 4, row_id: str = "id", ord_col: str = "ord") -> DataFrame:
    """First ``n`` rows per id in input order, ranked from 1 in ``sub``.

    The rank filter becomes a group limit, which cuts each id to ``n`` rows on
    the map side before the shuffle.
    """
    w = Window.partitionBy(row_id).orderBy(ord_col)
    return df.withColumn("sub", F.row_number().over(w)).filter(F.col("sub") <= n)


def feasible_shots(shots: Sequence[int], examples: DataFrame, row_id: str = "id") -> DataFrame:
    """Shot sizes the number of distinct examples allows."""
    n = examples.agg(F.count_distinct(row_id).alias("n_examples"))
    sizes = F.explode(F.array(*(F.lit(s) for s in shots))).alias("shots")
    return n.select(sizes, "n_examples").filter(F.col("shots") <= F.col("n_examples"))


def shot_prefixes(
    examples: DataFrame,
    shots: Sequence[int] = DEFAULT_SHOTS,
    seeds: Sequence[int] = (42,),
    row_id: str = "id",
) -> DataFrame:
    """The first ``shots`` shuffled examples for every shot size and seed.

    Shot sizes beyond the number of examples are left out. One row per
    (seed, shots, example) with its rank, so the result has at most
    ``sum(shots) * len(seeds)`` rows.
    """
    def first(seed: int) -> DataFrame:
        # a top-k per partition; only the leading rows meet in the small window
        key = shuffle_key(seed, F.col(row_id))
        top = examples.withColumn("_key", key).orderBy("_key", row_id).limit(max(shots))
        rank = F.row_number().over(Window.orderBy("_key", row_id)).cast("bigint")
        return top.withColumn("rn", rank).drop("_key").withColumn("seed", F.lit(seed))

    parts = [first(seed) for seed in seeds]
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    sizes = F.array(*(F.lit(s) for s in sorted(set(shots))))
    return (
        ranked.withColumn("_found", F.max("rn").over(Window.partitionBy("seed")))
        .withColumn(
            "shots",
            F.explode(F.filter(sizes, lambda s: (s >= F.col("rn")) & (s <= F.col("_found")))),
        )
        .drop("_found")
    )
