"""Label domains, masking and target fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_label
from .order import bounded_rows, local_rows, numbered, pinned

INLINE_LABELS = 1_000
NAME_LETTERS = 14  # letters of a masked name at most, more than a long counts


def label_domain(
    df: DataFrame, exclude: Sequence[str] = (), label: str = "label", ord_col: str = "ord"
) -> DataFrame:
    """Distinct labels with where each first appears; null-like ones are left out."""
    kept = df.select(canonical_label(F.col(label)).alias("label"), F.col(ord_col).alias("ord"))
    kept = kept.filter(F.col("label").isNotNull() & ~F.col("label").isin(list(exclude)))
    return kept.groupBy("label").agg(F.min("ord").alias("first_ord"))


def all_labels(
    filtered: DataFrame, exclude: Sequence[str] = (), columns: Sequence[str] = ("ori_label", "target_label")
) -> DataFrame:
    """Distinct union of several label columns."""
    each = F.explode(F.array(*(canonical_label(F.col(c)) for c in columns))).alias("label")
    kept = filtered.select(each)
    return kept.filter(F.col("label").isNotNull() & ~F.col("label").isin(list(exclude))).distinct()


def label_map(labels: DataFrame) -> DataFrame:
    """``label`` to ``concept A``, ``concept B`` … in label order, past Z as AA, AB …

    Labels are read once where they are few, as those of one system message are; more are
    numbered by ranges of the label order.
    """
    names = labels.select("label")
    few = local_rows(names)
    if few is not None:
        placed = few.withColumn("_i", F.row_number().over(Window.orderBy("label")).cast("bigint") - 1)
    else:
        placed = numbered(names, ["label"], "_i")

    def step(state, _):
        n, name = state["n"], state["name"]
        longer = F.concat(F.char(F.lit(65) + n % 26), name)
        rest = F.floor(n / 26).cast("bigint") - 1
        return F.struct(
            F.when(n >= 0, rest).otherwise(n).alias("n"), F.when(n >= 0, longer).otherwise(name).alias("name")
        )

    rounds = F.sequence(F.lit(1), F.lit(NAME_LETTERS))
    start = F.struct(F.col("_i").alias("n"), F.lit("").alias("name"))
    name = F.aggregate(rounds, start, step, lambda s: s["name"])
    return placed.select("label", F.concat(F.lit("concept "), name).alias("masked"))


def _renamed(label_map_df: DataFrame, column: str, out: str) -> DataFrame:
    return label_map_df.select(F.col("label").alias(column), F.col("masked").alias(out))


def mask_labels(df: DataFrame, lookup: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the masked form of each label column; rows with an unmapped label go."""
    lookup = pinned(lookup)
    for column, out in columns.items():
        df = df.join(_renamed(lookup, column, out), column)
    return df


def unmapped_labels(df: DataFrame, lookup: DataFrame, column: str) -> DataFrame:
    """How many rows :func:`mask_labels` drops, per label it does not know."""
    missing = df.join(pinned(lookup).select(F.col("label").alias(column)), column, "left_anti")
    return missing.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def unmask(df: DataFrame, lookup: DataFrame, masked: str = "y_pred", out: str = "label_pred") -> DataFrame:
    """Turn masked predictions back to labels; free-text answers give null."""
    back = pinned(lookup).select(F.col("masked").alias(masked), F.col("label").alias(out))
    return df.join(back, masked, "left")


def known_labels(df: DataFrame, lookup: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is in the map."""
    return df.join(pinned(lookup).select(F.col("label").alias(label)), label, "left_semi")


def fan_out_targets(
    patterns: DataFrame,
    labels: DataFrame,
    label: str = "ori_label",
    row_keys: Sequence[str] = ("ord", "pair_no", "phrase_no"),
) -> DataFrame:
    """Each (pattern row, phrase) with every label other than its own.

    ``labels`` are rows of :func:`label_domain`; ``target_no`` numbers them by
    first use. A label list of proven size becomes an array in the plan, so the
    pairing needs no join. A longer one is repeated once per salt and joined on
    the salt of the row: an equi-join whose keys stay even however the source
    labels are skewed.
    """
    phrases = patterns.select(
        *[c for c in patterns.columns if c != "phrases"],
        F.posexplode_outer("phrases").alias("phrase_no", "matched_phrase"),
    ).filter(F.col("matched_phrase").isNotNull())
    def first_use(row):
        return row["first_ord"] is not None, row["first_ord"] or 0, row["label"]

    rows = bounded_rows(labels.select("first_ord", "label"), INLINE_LABELS)
    if rows is not None:
        targets = F.array(
            *(
                F.struct(F.lit(i).alias("target_no"), F.lit(r["label"]).alias("target_label"))
                for i, r in enumerate(sorted(rows, key=first_use))
            )
        ).cast("array<struct<target_no:int,target_label:string>>")
        others = F.filter(targets, lambda t: t["target_label"] != F.col(label))
        return phrases.select("*", F.inline(others))

    salts = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64(*row_keys), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    placed = numbered(labels.select("first_ord", "label"), ["first_ord", "label"], "_place")
    targets = placed.select(
        F.col("_place").cast("int").alias("target_no"), F.col("label").alias("target_label")
    ).withColumn("_salt", F.explode(every))
    return (
        salted.join(targets, "_salt")
        .filter(F.col("target_label") != F.col(label))
        .drop("_salt")
    )
