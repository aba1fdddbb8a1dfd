"""Vector codes by four codebooks, trained with members resident at their entry's owner.

A vector of integers is cut into four parts. All parts live in written tables dealt out by
(position, entry, salt): an owner holds members of its entries. A round reads the owners' tables
where they are, sums resident members to new entries, and finds each part's nearest entry. Parts
that stay are written again by the task that read them, without a shuffle; only parts that change
their entry go through the exchange to their next owner. Salts deal a frequent entry out to as
many owners as its rows need, so no task holds a whole entry.

Results that are defined here: vectors that are null or hold null or non-finite components are
left out; repeated rows and ids are coded row by row; null ids sort last; of repeated ids the
smaller vectors come first among the first 256; with fewer kept rows there are fewer entries;
an empty table gives no rows. All vectors must have one length, a multiple of four, and
components below 2**17 in size; others raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, new_path, tidy, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts an owner holds, about; it only sets how many owners there are.
OWNER_PARTS = 16_384
#: Components as integers; squared distances of whole vectors then fit a long, whatever the length.
LARGEST = 1 << 27
#: Up to this size all products and sums are exact in double precision.
EXACT = 1 << 21

MEMBER = "row bigint, position int, entry int, salt int, v array<int>"

Codebooks = list[np.ndarray]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def nearest_entry(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest index of the nearest entries and its squared distance, exactly."""
    kind = np.float64 if max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) <= EXACT else np.int64
    x, c = points.astype(kind), book.astype(kind)
    far = (c * c).sum(1) - 2 * (x @ c.T)
    best = far.argmin(1)
    return best, (far[np.arange(len(x)), best] + (x * x).sum(1)).astype(np.int64)


def _points(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assigned(books: Codebooks):
    """Members with their nearest entries now; ``moved`` says whose entry is another one."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            points = _points(batch.column("v"), books[0].shape[1])
            entry = np.zeros(len(position), np.int32)
            error = np.zeros(len(position), np.int64)
            for p, book in enumerate(books):
                at = position == p
                if at.any():
                    entry[at], error[at] = nearest_entry(points[at], book)
            moved = entry != batch.column("entry").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("position"), pa.array(entry), batch.column("salt"), batch.column("v"), pa.array(error), pa.array(moved)],
                ["row", "position", "entry", "salt", "v", "error", "moved"],
            )

    return rows


def assigned(members: DataFrame, books: Codebooks) -> DataFrame:
    return members.mapInArrow(_assigned(books), f"{MEMBER}, error bigint, moved boolean")


class Owners:
    """The written tables of members: what stayed where it was, and what the last exchange brought."""

    def __init__(self, rows: DataFrame, count: int):
        self.spark = rows.sparkSession
        self.owners = max(2, math.ceil(PARTS * count / OWNER_PARTS))
        self.paths = [self._dealt(rows)]

    def _dealt(self, rows: DataFrame) -> str:
        path = new_path(self.spark, "members")
        written(rows.repartition(self.owners, "position", "entry", "salt"), path)
        return path

    def members(self) -> DataFrame:
        """All members, each read where its owner wrote it."""
        return self.spark.read.schema(MEMBER).parquet(*self.paths)

    def updated(self, books: Codebooks) -> Codebooks:
        """New entries from resident members: rounded down means, old entries where there are none."""
        width = books[0].shape[1]
        sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)]
        rows = self.members().groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
        after = [book.copy() for book in books]
        for r in rows:  # PARTS * ENTRIES rows at most
            after[r["position"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        return after

    def migrate(self, books: Codebooks) -> None:
        """Assign all members; those whose entry changes go to its owner, the others stay in their files' order."""
        path = new_path(self.spark, "assigned")
        held = assigned(self.members(), books).drop("error")
        held.write.partitionBy("moved").parquet(path)
        both = self.spark.read.schema(f"{MEMBER}, moved boolean").parquet(path)
        arrived = self._dealt(both.where("moved").drop("moved"))
        for old in self.paths:
            discard(self.spark, old)
        stayed = f"{path}/moved=false"
        here = self.spark._jvm.org.apache.hadoop.fs.Path(stayed)
        there = here.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(here)
        discard(self.spark, f"{path}/moved=true")
        self.paths = [stayed, arrived] if there else [arrived]


def first_entries(base: DataFrame) -> Codebooks:
    """The parts of the vectors with the smallest ids, at most ``ENTRIES`` of them."""
    rows = base.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    whole = np.array([r["v"] for r in rows], np.int64)
    return [np.ascontiguousarray(x) for x in np.split(whole, PARTS, axis=1)]


def books_digest(books: Codebooks) -> str:
    listed = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return hashlib.sha256(listed.encode()).hexdigest()


def compressed(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(row, id, label, code, error) of each usable vector, and the codebooks behind the codes.

    ``code`` holds the entry of each part as two hex digits, ``error`` the squared distance to them.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector))).select(
        F.col(id).alias("id"), F.col(label).alias("label"), whole_numbers(F.col(vector)).alias("v")
    )
    path = new_path(spark, "vectors")
    written(kept.select(F.monotonically_increasing_id().alias("row"), "*"), path)
    base = spark.read.parquet(path)
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    shape = base.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(size).alias("size")).first()
    if shape["n"] == 0:
        return base.select("row", "id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    if shape["low"] != shape["high"] or shape["low"] % PARTS:
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    if shape["size"] > LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE} in size")

    books = first_entries(base)
    width = shape["low"] // PARTS
    salts = math.ceil(shape["n"] / OWNER_PARTS)
    parts = base.select(
        "row",
        F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("position"),
        F.lit(-1).alias("entry"),
        F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"),
        "v",
    ).withColumn("v", F.slice("v", F.col("position") * width + 1, F.lit(width)).cast("array<int>"))

    owners = Owners(assigned(parts, books).drop("error", "moved"), shape["n"])
    for number in range(rounds):
        books = owners.updated(books)
        if number < rounds - 1:
            owners.migrate(books)

    found = assigned(owners.members(), books).groupBy("row").agg(
        *(F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"e{p}") for p in range(PARTS)),
        F.sum("error").alias("error"),
    )
    code = F.lower(F.concat(*(F.lpad(F.hex(f"e{p}"), 2, "0") for p in range(PARTS))))
    coded = found.select("row", code.alias("code"), "error").join(base.select("row", "id", "label"), "row")
    return coded.select("row", "id", "label", "code", "error"), books


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Codes turned back to the vectors that they stand for, in units of the original vectors."""
    if not books:
        return coded.withColumn("approximation", F.array().cast("array<double>"))
    near = [book.astype(np.float64) / SCALE for book in books]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [bytes.fromhex(x) for x in batch.column("code").to_pylist()]
            vectors = [np.concatenate([near[p][e] for p, e in enumerate(code)]).tolist() for code in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, "approximation"])

    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(rows, f"{listed}, approximation array<double>")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all rows with an equal label, null labels together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return coded.join(sums, coded["label"].eqNullSafe(sums["__label"])).drop("__label")
