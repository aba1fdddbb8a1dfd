"""CSV files cut into blocks that tasks read on their own, although fields may hold line breaks.

Whether a byte lies inside a quoted field depends on all quotes before it. Quotes are counted per
block first; the parities summed along the blocks of a file say for each block whether it begins
inside a field. Then every block is cut into records where it lies. Only a record that crosses the
end of a block is put together from pieces, at most two a block, by the number it began with.

Quotes are doubled inside of quoted fields and do not occur in others, as this library's dialect
has it. Empty lines between records are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import earlier, local_rows, pinned
# The CSV dialect (doubled quotes, fields that span lines).
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}

KEYS = ["_file", "_block"]
BLOCK = "_file string, _block bigint, _quotes bigint, _even bigint, _odd bigint, _last bigint"
PIECE = "_file string, _block bigint, _begins boolean, _ord bigint, _whole boolean, _text string"


def _stripped(lines: pa.Array) -> pa.Array:
    """Lines without the carriage return before their break."""
    ends = pc.ends_with(lines, "\r")
    return pc.if_else(ends, pc.utf8_slice_codeunits(lines, 0, -1), lines) if pc.any(ends).as_py() else lines


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of a batch that lie in one block."""
    files, blocks = batch.column("_file"), batch.column("_block").to_numpy()
    names = files.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(names) != 0)) + 1
    for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
        if high > low:
            yield files[int(low)].as_py(), int(blocks[low]), batch.slice(low, high - low)


def _quotes(part: pa.RecordBatch) -> np.ndarray:
    return pc.count_substring(part.column("value"), '"').to_numpy(zero_copy_only=False)


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each block, and its lines that begin a record if the block begins outside or inside a field."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for name, block, part in _runs(batch):
            row = found.setdefault((name, block), [0, 0, 0])
            quotes = _quotes(part)
            inside = (row[0] + np.cumsum(quotes) - quotes) % 2
            some = pc.not_equal(_stripped(part.column("value")), "").to_numpy(zero_copy_only=False)
            row[0] += int(quotes.sum())
            row[1] += int((some & (inside == 0)).sum())
            row[2] += int((some & (inside == 1)).sum())
    rows = [(*key, *row, key[1]) for key, row in found.items()]
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.string()] + [pa.int64()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in BLOCK.split(", ")])


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie inside a block, and the pieces of those that do not."""
    held: list[str] = []  # lines of the record that is open
    at, begins, number, inside, header = None, True, 0, False, False
    out: list[tuple] = []

    def close(whole: bool) -> None:
        """Hand on the open record; the first one of a file is its header."""
        nonlocal header, number, begins
        if held:
            if begins and header:
                out.append((*at, True, -1, whole, None if whole else "\n".join(held)))
                header = False
            else:
                out.append((*at, begins, number if begins else None, whole, "\n".join(held)))
                number += begins
        held.clear()
        begins = True

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
        columns = list(zip(*out)) if out else [()] * 6
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECE.split(", ")])
        out.clear()
        return made

    for batch in batches:
        for name, block, part in _runs(batch):
            if (name, block) != at:
                close(False)  # what is still open goes on in the next block
                at, number = (name, block), part.column("_start")[0].as_py()
                inside = bool(part.column("_inside")[0].as_py())
                begins, header = not inside, block == 0
            for text, quotes in zip(_stripped(part.column("value")).to_pylist(), _quotes(part).tolist()):
                if not inside and not held and not text:
                    continue
                held.append(text)
                inside ^= bool(quotes % 2)
                if not inside:
                    close(begins)
        yield batch_of()
    close(False)
    yield batch_of()


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with whether they begin inside a field, and the number of their first record."""
    few = local_rows(blocks)
    blocks = blocks if few is None else few
    state = earlier(blocks, "_last", {"_before": ("sum", F.col("_quotes"))}, ["_file"])
    state = state.withColumn("_inside", F.coalesce(F.col("_before") % 2, F.lit(0)) == 1)
    begin = F.when(F.col("_inside"), F.col("_odd")).otherwise(F.col("_even"))
    headers = F.when((F.col("_block") == 0) & (begin > 0), 1).otherwise(0)
    starts = earlier(state.withColumn("_records", begin - headers), KEYS, {"_start": ("sum", F.col("_records"))})
    return starts.select(*KEYS, "_inside", F.coalesce("_start", F.lit(0)).alias("_start"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, _record): the text of every record but the headers, numbered from 0 in the order of files and bytes."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value"
    )
    counted = lines.mapInArrow(_count_blocks, BLOCK)
    blocks = counted.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("_quotes", "_even", "_odd")), F.max("_last").alias("_last"))
    placed = _placed(blocks)
    few = local_rows(placed)
    if few is not None:
        located = lines.join(pinned(few), KEYS)
    else:
        ordered = lines.withColumn("_line", F.monotonically_increasing_id()).join(placed, KEYS)
        located = ordered.repartition(*KEYS).sortWithinPartitions(*KEYS, "_line").drop("_line")
    pieces = located.mapInArrow(_cut_records, PIECE)
    whole = pieces.filter("_whole AND _ord >= 0").select("_ord", F.col("_text").alias("_record"))
    parts = pieces.filter("NOT _whole")
    ends = parts.select("_file", "_block", F.when(F.col("_begins"), F.col("_ord")).alias("_began"))
    tails = ends.groupBy(*KEYS).agg(F.max("_began").alias("_began"))
    owner = earlier(tails, "_block", {"_owner": ("max", F.col("_began"))}, ["_file"]).select(*KEYS, "_owner")
    owned = parts.join(owner, KEYS).withColumn("_own", F.when(F.col("_begins"), F.col("_ord")).otherwise(F.col("_owner")))
    listed = F.array_sort(F.collect_list(F.struct("_block", "_text")))
    joined = owned.filter("_own >= 0").groupBy("_file", "_own").agg(F.array_join(F.transform(listed, lambda x: x["_text"]), "\n").alias("_record"))
    return whole.unionByName(joined.select(F.col("_own").alias("_ord"), "_record"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, and ``_ord``."""
    names = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    fields = F.from_csv("_record", schema, {"quote": '"', "escape": '"'}).alias("_fields")
    return csv_records(spark, path).select("_ord", fields).select("_fields.*", "_ord")
