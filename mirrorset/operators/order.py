"""Order-dependent work without a single-task window.

A window over a whole table runs in one task. The helpers here cut the order
into buckets, reduce each bucket to one row, run the window over those few rows,
and finish inside the buckets in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 65_536
HASH_DIGITS = 4
#: Ranges an order is cut into at most, and sampled rows a range.
MAX_RANGES = 1_000
SAMPLE_ROWS = 20
#: Values an order may span for each row, so that ranges of even width hold a fair share of rows.
DENSE_SPAN = 8


def bounded_rows(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of a small table, or None when it has more than ``max_rows``.

    Never reads more than ``max_rows + 1`` rows to the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def pinned(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A lookup table, broadcast only once its size is proven.

    A table within the bound becomes a local relation with a broadcast hint; a
    larger one comes back untouched, so that joins on it shuffle (and adaptive
    execution splits its hot keys).
    """
    rows = bounded_rows(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that has fewer splits than there are cores.

    A small file is one split, so text work on it would run in one task. Inputs
    with enough splits, as every large table has, come back untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_key(seed: int | Column, row_id: Column) -> Column:
    """Repeatable pseudo-random order: md5 of seed and id."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", seed.cast("string"), row_id.cast("string")))


def shuffled_rank(
    df: DataFrame,
    seed: int,
    row_id: str = "id",
    keys: Sequence[str] = (),
    limit: int | None = None,
    out: str = "rn",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """1-based rank of each row in the seeded shuffle, per ``keys``.

    The first hex digits of the shuffle key spread any group evenly over 65,536
    buckets (more with more ``digits``), also one key that holds most rows. A first pass over ids counts
    rows per bucket; the second ranks inside buckets. With ``limit``, only the
    leading buckets of a group reach the shuffle at all. ``keys`` must not be
    null. Rows of one ``row_id`` are ordered by ``ord`` where there is such a column; without
    one, ``row_id`` must be unique in a group.
    """
    keys = list(keys)
    hashed = df.withColumn("_key", shuffle_key(seed, F.col(row_id))).withColumn(
        "_bucket", F.substring("_key", 1, digits)
    )
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    if limit is not None:
        starts = pinned(starts.filter(F.col("_before") < limit))
    ties = ["ord"] if "ord" in df.columns and row_id != "ord" else []
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_key", row_id, *ties)
    ranked = hashed.join(starts, [*keys, "_bucket"]).withColumn(
        out, (F.col("_before") + F.row_number().over(inside)).cast("bigint")
    )
    if limit is not None:
        ranked = ranked.filter(F.col(out) <= limit)
    return ranked.select(*df.columns, out)


def range_bounds(df: DataFrame, order: Sequence[str], ranges: int) -> list[Row]:
    """Values that cut the order into ``ranges`` parts with about as many rows each.

    They are quantiles of a sample: the rows with the smallest hashes of the order, ``SAMPLE_ROWS`` a
    range. So they do not depend on how the values lie, and are the same whenever they are computed.
    """
    if ranges < 2:
        return []
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(ranges * SAMPLE_ROWS)
    rows = sample.orderBy(*order).collect()
    cuts = [rows[i * len(rows) // ranges] for i in range(1, ranges)] if rows else []
    return list(dict.fromkeys(cuts))


def range_of(df: DataFrame, order: Sequence[str], bounds: Sequence[Row]) -> Column:
    """In which of the ranges a row lies, from 0: a binary search in the bounds."""
    if not bounds:
        return F.lit(0).cast("bigint")
    kinds = [df.schema[c].dataType for c in order]

    def literal(row: Row) -> Column:
        return F.struct(*(F.lit(x).cast(kind).alias(c) for c, x, kind in zip(order, row, kinds)))

    table = F.array(*map(literal, bounds))

    def halve(at: Column, value: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        after = F.element_at(table, F.least(middle + 1, F.lit(len(bounds)))) <= value
        open_ = at["low"] < at["high"]
        return F.struct(
            F.when(open_ & after, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(open_ & ~after, middle).otherwise(at["high"]).alias("high"),
        )

    # the row's value comes in by the steps: what only the lambda mentions, Spark may look for on the wrong side of a join
    steps = F.array_repeat(F.struct(*order), len(bounds).bit_length())
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, start, halve, lambda at: at["low"].cast("bigint"))


def _bucket(df: DataFrame, order: Sequence[str], bucket_rows: int) -> Column:
    """A number that grows along the order and that about ``bucket_rows`` rows share.

    A dense order of whole numbers has ranges of even width; any other one ranges of even count, at
    most ``MAX_RANGES``. Both give the same results in the end.
    """
    first = order[0]
    whole = len(order) == 1 and df.schema[first].dataType.typeName() in ("long", "integer", "short", "byte")
    ends = (F.min(first), F.max(first)) if whole else ()
    n, *span = df.agg(F.count(F.lit(1)), *ends).first()
    if whole and (span[0] is None or span[1] - span[0] < DENSE_SPAN * n):
        return F.floor(F.col(first) / bucket_rows)
    return range_of(df, order, range_bounds(df, order, min(MAX_RANGES, -(-n // bucket_rows))))


def earlier(
    df: DataFrame,
    ord_col: str | Sequence[str],
    values: dict[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
    inclusive: bool = False,
) -> DataFrame:
    """Running ``sum`` or ``max`` along ``ord_col``, one window per bucket.

    ``values`` maps an output column to ``(how, expression)``. By default the
    row itself is left out, so the first row gets null. ``ord_col`` is a column or several of
    any type that sorts, unique per ``keys``; its values may be as sparse as times or hashes.
    Keys must not be null, nor may a single order column.
    """
    keys = list(keys)
    order = [ord_col] if isinstance(ord_col, str) else list(ord_col)
    how = {"sum": F.sum, "max": F.max}
    base = df.withColumn("_bucket", _bucket(df, order, bucket_rows))
    for name, (_, expr) in values.items():
        base = base.withColumn(f"_v_{name}", expr)
    # The join below drops null keys; saying so here keeps both uses of the rows
    # alike, so that Spark computes and shuffles their common part once.
    for key in [*keys, "_bucket"]:
        base = base.filter(F.col(key).isNotNull())
    totals = base.groupBy(*keys, "_bucket").agg(
        *(how[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in values.items())
    )
    prior = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        "_bucket",
        *(how[kind](f"_t_{name}").over(prior).alias(f"_o_{name}") for name, (kind, _) in values.items()),
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    joined = base.join(offsets, [*keys, "_bucket"])
    for name, (kind, _) in values.items():
        local, offset = how[kind](f"_v_{name}").over(inside), F.col(f"_o_{name}")
        if kind == "sum":
            total = F.when(
                local.isNotNull() | offset.isNotNull(),
                F.coalesce(local, F.lit(0)) + F.coalesce(offset, F.lit(0)),
            )
        else:
            total = F.greatest(local, offset)
        joined = joined.withColumn(name, total)
    return joined.select(*[c for c in df.columns if c not in values], *values)


def numbered(df: DataFrame, order: Sequence[str], out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the 0-based place of every row along ``order``, without gaps: ranges, their counts, places inside."""
    return earlier(df, order, {out: ("sum", F.lit(1).cast("bigint"))}, bucket_rows=bucket_rows).withColumn(
        out, F.coalesce(out, F.lit(0).cast("bigint"))
    )


def local_rows(df: DataFrame, max_rows: int = 10_000) -> DataFrame | None:
    """A small table as a local relation, which no later step computes again; None when it has more rows."""
    rows = bounded_rows(df, max_rows)
    return None if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def beside(wide: DataFrame, narrow: DataFrame, keys: Sequence[str], group: str, inner: bool = False) -> DataFrame:
    """Join rows of ``narrow`` to those of ``wide`` with equal keys, where all rows of a ``group`` meet.

    A join on several keys deals rows out by all of them, so the texts of an example go everywhere, and each
    copy takes its room. Here both sides are dealt out by ``group``, one of the keys or a column that they
    determine, and lie side by side afterwards, so that copies compress in shuffles and in files. A left join, or an inner
    one; null keys are equal.
    """
    added = [c for c in narrow.columns if c not in keys]
    found = narrow.select(*keys, F.struct(F.lit(True).alias("_met"), *added).alias("_found"))
    both = wide.withColumn("_found", F.lit(None).cast(found.schema["_found"].dataType)).unionByName(found, allowMissingColumns=True)
    all_found = F.collect_list("_found").over(Window.partitionBy(*keys))
    joined = both.repartition(group).withColumn("_all", all_found).filter(F.col("_found").isNull())
    each = F.explode if inner else F.explode_outer
    return joined.select(*wide.columns, each("_all").alias("_one")).select(*wide.columns, *(F.col("_one")[c].alias(c) for c in added))


#: Groups that a task places at a time: each may have many rows with long texts.
GROUPS = 4_096


def dense_order(
    df: DataFrame,
    group: str,
    within: Sequence[str],
    out: str = "place",
    bucket_rows: int = GROUPS,
) -> DataFrame:
    """0-based running number along (``group``, ``within``) without gaps.

    Rows are dealt out by ranges of groups, once, and come out in their order range by range; a
    group, such as the rows of one example, is small. Rows without a group go.
    """
    base = df.withColumn("_bucket", _bucket(df, [group], bucket_rows)).filter(F.col(group).isNotNull())
    counts = base.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(group, *within)) - 1
    placed = base.join(starts, "_bucket").withColumn(out, F.col("_start") + inside)
    return placed.select(*df.columns, out)
