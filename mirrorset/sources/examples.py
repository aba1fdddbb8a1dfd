"""Labelled tables with column roles, and list text of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_null, let, strip
from ..operators.order import earlier, local_rows, pinned
from .csvblocks import CSV_OPTIONS, read_csv

def _is_csv(path: str) -> bool:
    return path.rstrip("/").endswith((".csv", ".csv.gz"))


def read_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file in this library's dialect (by suffix), else parquet.

    Large CSV files are split, also where fields span lines. Without ``multi_line``
    they must not, and Spark's own reader does the splitting.
    """
    if _is_csv(path):
        if multi_line:
            return read_csv(spark, path).drop("_ord")
        return spark.read.options(**CSV_OPTIONS).csv(path)
    return spark.read.parquet(path)


def read_examples(
    spark: SparkSession,
    path: str,
    id: str,
    text: str,
    label: str,
    ord: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """``(id, text, label, ord)`` out of a file whose columns have other names.

    ``ord`` names a source column with the row order. Without one, rows are
    numbered from 0 in file order: by row index for parquet, by records of each
    file block for CSV.
    """
    by_blocks = _is_csv(path) and multi_line
    df = read_csv(spark, path) if by_blocks else read_table(spark, path, multi_line)
    missing = [c for c in (id, text, label) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if ord is None:
        df, ord = df if by_blocks else number_rows(df, by_index=not _is_csv(path)), "_ord"

    def role(name: str) -> Column:
        return canonical_null(F.col(name).cast("string"))

    return df.select(
        role(id).alias("id"),
        role(text).alias("text"),
        role(label).alias("label"),
        F.col(ord).cast("bigint").alias("ord"),
    )


def number_rows(df: DataFrame, by_index: bool) -> DataFrame:
    """Dense 0-based ``_ord`` in file order for a DataFrame read from files.

    Rows are counted per file block; the running total over blocks gives each
    block its start. A small table of blocks is sent to all tasks, a larger one is
    summed by ranges and joined.
    """
    block = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    if by_index:
        block[1] = F.lit(0).cast("bigint")
        place = F.col("_metadata.row_index")
    else:
        place = F.monotonically_increasing_id()
    placed = df.select("*", block[0].alias("_file"), block[1].alias("_block"), place.alias("_place"))
    blocks = placed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_low")
    )
    return (
        placed.join(block_totals(blocks, {"_start": ("sum", F.col("_n"))}).drop("_n"), ["_file", "_block"])
        .withColumn("_ord", F.col("_start") + F.col("_place") - F.col("_low"))
        .drop("_file", "_block", "_place", "_low", "_start")
    )


def block_totals(blocks: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running totals over the blocks before each (0 for the first), broadcast if they are few."""
    few = local_rows(blocks)
    order = ["_file", "_block"]
    if few is None:
        totals = earlier(blocks, order, values)
    else:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = {name: F.sum(expr).over(before) for name, (_, expr) in values.items()}
        totals = pinned(few.withColumns(sums))
    return totals.withColumns({name: F.coalesce(name, F.lit(0)) for name in values})


# Escapes in list text, and private-use characters (which such text never holds
# itself) that keep them apart while the quotes are matched.
_ESCAPES = [
    ("\\\\", "\ue000", "\\"),
    ("\\'", "\ue001", "'"),
    ('\\"', "\ue002", '"'),
    ("\\n", "\ue003", "\n"),
    ("\\t", "\ue004", "\t"),
    ("\\r", "\ue005", "\r"),
]


# Characters written by their code, such as \\x07 and \\u200b.
_CODES = r"\\x[0-9a-f]{2}|\\u[0-9a-f]{4}"


def parse_repr_list(col: Column) -> Column:
    """List text such as ``[[['a']], [["b's"]]]`` as ``ARRAY<STRING>``.

    Elements are in single quotes, or in double quotes when they hold an
    apostrophe and no double quote; a backslash escapes the next character or
    leads a character code. Null when the text is no list at all.
    """
    marked = col
    for escaped, mark, _ in _ESCAPES:
        marked = F.replace(marked, F.lit(escaped), F.lit(mark))

    def plain(item: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(item, F.lit(_CODES), F.lit(0)))
        item = F.aggregate(
            codes,
            item,
            lambda out, c: F.replace(out, c, F.decode(F.unhex(F.lpad(F.substring(c, 3, 4), 4, "0")), "UTF-16BE")),
        )
        for _, mark, char in _ESCAPES:
            item = F.replace(item, F.lit(mark), F.lit(char))
        return item

    def items(text: Column) -> Column:
        quoted = F.lit("'([^']*)'|\"([^\"]*)\"")
        single = F.regexp_extract_all(text, quoted, F.lit(1))
        double = F.regexp_extract_all(text, quoted, F.lit(2))
        return F.zip_with(single, double, lambda s, d: plain(F.when(s != "", s).otherwise(d)))

    trimmed = strip(col)
    return F.when(trimmed.startswith("[") & trimmed.endswith("]"), let(marked, items))


def import_patterns(df: DataFrame) -> DataFrame:
    """Pattern rows of an earlier run; rows whose list text does not parse are skipped."""
    return df.select(
        "id", "ori_text", "ori_label", "pattern", parse_repr_list(F.col("highlight")).alias("phrases")
    ).filter(F.col("phrases").isNotNull())


def import_candidates(df: DataFrame) -> DataFrame:
    """Candidate rows of an earlier run, with the phrases of their list text.

    Text that is no list is kept as one phrase, as the rewriting step is shown it as it is.
    """
    listed = parse_repr_list(F.col("candidate_phrases"))
    whole = F.when(F.col("candidate_phrases").isNotNull(), F.array("candidate_phrases"))
    return df.withColumn("candidate_phrases", F.coalesce(listed, whole))
