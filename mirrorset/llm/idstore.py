"""Token ids in files, with Elias-Fano document boundaries.

A store is a Parquet folder. Each row is a segment: the concatenated ids of a run of
documents as packed numbers, and the start of each document in it as an Elias-Fano
sequence: the low bits of every start side by side, the high bits in unary, and the
place of every 64th one-bit, from which ``select`` reads a start without a table of
64-bit offsets. Segments close at a document end once they hold ``segment_ids`` ids,
so a task holds one segment or one longer document. A shard is a range of doc_id.

Null text is empty (the end id alone), null doc_id sorts first, repeated rows are kept
one by one, an empty table gives an empty store, other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .staging import chunks, written

SAMPLE = 64
SEGMENT = "shard int, segment long, first_id long, n_docs long, n_ids long, id_bytes int, doc_ids array<bigint>, low_bits int, low binary, high binary, samples binary, ids binary"


@dataclass
class EliasFano:
    """A non-decreasing sequence of whole numbers, all below ``universe``."""

    size: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return cls(n, low_bits, pack(low), pack(high), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one-bit on, at most 64 one-bits are passed."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        place = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        word = self.high[byte] >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        at, low = i * self.low_bits, 0
        for k in range(self.low_bits):
            low |= (self.low[(at + k) >> 3] >> ((at + k) & 7) & 1) << k
        return (place - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        unpack = lambda bits: np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        high = np.flatnonzero(unpack(self.high))[: self.size] - np.arange(self.size)
        if not self.low_bits:
            return high
        low = unpack(self.low)[: self.size * self.low_bits].reshape(self.size, self.low_bits).astype(np.int64)
        return (high << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)


class _Segment:
    """The documents gathered for the next row of a store."""

    def __init__(self, shard: int, width: int) -> None:
        self.shard, self.width, self.number, self.first = shard, width, 0, 0
        self.clear()

    def clear(self) -> None:
        self.doc_ids, self.parts, self.starts, self.n_ids = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.parts.append(ids)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids) // self.width

    def close(self) -> pa.RecordBatch:
        ef = EliasFano.of(np.array(self.starts), self.n_ids)
        row = {
            "shard": (self.shard, pa.int32()),
            "segment": (self.number, pa.int64()),
            "first_id": (self.first, pa.int64()),
            "n_docs": (len(self.doc_ids), pa.int64()),
            "n_ids": (self.n_ids, pa.int64()),
            "id_bytes": (self.width, pa.int32()),
            "doc_ids": (self.doc_ids, pa.list_(pa.int64())),
            "low_bits": (ef.low_bits, pa.int32()),
            "low": (ef.low, pa.binary()),
            "high": (ef.high, pa.binary()),
            "samples": (ef.samples, pa.binary()),
            "ids": (b"".join(self.parts), pa.binary()),
        }
        self.number += 1
        self.first += self.n_ids
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row.values()], list(row))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_ids: int = 1 << 20) -> None:
    """Encode (doc_id, text) and write a store in ascending doc_id order."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(tokenizer, "lead")
        end = np.array([end_id], run.dtype).tobytes()
        segment = _Segment(TaskContext.get().partitionId(), run.dtype.itemsize)
        for batch in batches:
            for part in chunks(batch):
                encoded = run.encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    segment.add(doc_id, ids + end)
                    if segment.n_ids >= segment_ids:
                        yield segment.close()
        if segment.doc_ids:
            yield segment.close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    written(ordered.mapInArrow(segments, SEGMENT), path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store, with ``base``: the ids in all shards before the segment's own.

    The totals by shard are one small row a shard; only they meet in one task and are broadcast.
    """
    store = spark.read.schema(SEGMENT).parquet(path)
    totals = store.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("base"))
    return store.join(F.broadcast(bases), "shard")


def _documents(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ef = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
            ids, width, n = memoryview(row["ids"]), row["id_bytes"], row["n_docs"]
            for first in range(0, n, at_once):
                last = min(first + at_once, n)
                starts = [ef.select(i) for i in range(first, last)]
                ends = [*starts[1:], ef.select(last) if last < n else row["n_ids"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"][first:last], pa.int64()),
                        pa.array(np.array(starts, np.int64) + (row["base"] + row["first_id"])),
                        pa.array([bytes(ids[a * width : b * width]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array(np.full(last - first, width, np.int32)),
                    ],
                    ["doc_id", "start", "ids", "id_bytes"],
                )


def read_documents(segments: DataFrame, at_once: int = 1024) -> DataFrame:
    """One row per stored document: doc_id, start (ids before it in the whole store), ids (packed), id_bytes.

    Boundaries are found by ``select``, ``at_once`` documents at a time; a segment's starts are never spread out.
    """
    return segments.mapInArrow(lambda batches: _documents(batches, at_once), "doc_id long, start long, ids binary, id_bytes int")


def read_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Point reads: ``places`` holds (shard, segment, place); each document is found by ``select`` in its segment."""
    joined = segments.join(places, ["shard", "segment"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                i, width = row["place"], row["id_bytes"]
                a = ef.select(i)
                b = ef.select(i + 1) if i + 1 < row["n_docs"] else row["n_ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"][i]], pa.int64()), pa.array([row["base"] + row["first_id"] + a], pa.int64()), pa.array([row["ids"][a * width : b * width]], pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    return joined.mapInArrow(pick, "doc_id long, start long, ids binary")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x, f"<u{w}") for x, w in zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("start"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def id_digest(documents: DataFrame) -> DataFrame:
    """n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit numbers."""
    return documents.mapInArrow(_digests, DIGEST)


def stored_digest(segments: DataFrame, at_once: int = 1024) -> DataFrame:
    """``id_digest`` of ``read_documents`` in one worker a task: the ids that are read do not go through a second one."""
    return segments.mapInArrow(lambda batches: _digests(_documents(batches, at_once)), DIGEST)
