"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the ``k`` smallest hashes of a text's distinct shingles of five words (fewer
words: the whole sequence), as base64 of big-endian 64-bit numbers. A text with at most ``k``
shingles is held whole. Fingerprints of parts merge into that of the whole, and
give estimates of resemblance, containment and the number of distinct shingles.

Null, empty and wordless texts have the empty fingerprint; two empty ones are alike by 1,
an empty and another one by 0. Rows of one doc_id are ordered by a text hash, null doc_id
comes first, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import shingle_sets
from .staging import chunks

K = 128
SPAN = float(1 << 64)


def sketch(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    return [x[:k] for x in shingle_sets(texts)]


def merged(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the sets."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def distinct(x: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(x)) if len(x) < k else (k - 1) / ((float(x[-1]) + 1) / SPAN)


def resemblance(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union: the share of the union's sketch that both hold."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = merged([x, y], k)
    return len(np.intersect1d(np.intersect1d(x, y, True), both, True)) / len(both)


def containment(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated share of x's shingles that y holds."""
    if not len(x):
        return 1.0
    return min(1.0, resemblance(x, y, k) * distinct(merged([x, y], k), k) / distinct(x, k))


def written(x: np.ndarray) -> str:
    return base64.b64encode(x.astype(">u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                texts = [(t or "").encode() for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(map(written, sketch(texts, k)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, fingerprint string")


def merge_fingerprints(table: DataFrame, by: str, k: int = K) -> DataFrame:
    """One fingerprint for each value of ``by``: parts are merged in tasks first, so a frequent value moves one row a task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, prints in batch.groupby(by, dropna=False)["fingerprint"]:
                key = None if pd.isna(key) else key
                held[key] = merged([held.get(key, np.zeros(0, np.uint64)), *map(read, prints)], k)
        yield pd.DataFrame({by: list(held), "fingerprint": [written(x) for x in held.values()]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: rows[by].iloc[:1], "fingerprint": [written(merged([read(x) for x in rows["fingerprint"]], k))]})

    schema = table.select(by, "fingerprint").schema
    return table.select(by, "fingerprint").mapInPandas(partial, schema).groupBy(by).applyInPandas(whole, schema)


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """Documents in ``ranges`` runs of ascending doc_id, each run followed by the first document of the next.

    Range bounds are ids that occur, so the first document of a run is known by its id, and a second copy of it
    goes to the run before (``sentinel``; that of the first run to the last). Rows: run, doc_id, text, tie, sentinel.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    facts = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts") if ranges > 1 else F.lit(None).alias("cuts")).first()
    bounds = np.array(sorted({*(facts["cuts"] or []), *([] if facts["low"] is None else [facts["low"]])}), np.int64)
    n = max(1, len(bounds))

    @F.pandas_udf("array<int>")
    def runs(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy()
        run = np.maximum(np.searchsorted(bounds, ids, "right") - 1, 0)
        first = bounds[run] == ids if len(bounds) else np.zeros(len(ids), bool)
        return pd.Series([[r, (r - 1) % n + n] if f else [r] for r, f in zip(run.tolist(), first.tolist(), strict=True)])

    each = docs.withColumn("tie", F.xxhash64("text")).withColumn("run", F.explode(runs("doc_id")))
    each = each.withColumn("sentinel", F.col("run") >= n).withColumn("run", F.pmod("run", F.lit(n)))
    return each.repartitionByRange("run").sortWithinPartitions("run", "sentinel", "doc_id", "tie")


def with_edited(docs: DataFrame, ranges: int, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the beginning of the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        run, ended = None, False

        def close(texts: list[str], ids: list[int]) -> pa.RecordBatch:
            halves = [len(t) // 2 for t in texts[:-1]]
            edited = [t[: len(t) - h] + u[:h] for t, u, h in zip(texts, texts[1:], halves, strict=False)]
            own = sketch([t.encode() for t in texts], k)
            new = sketch([t.encode() for t in edited], k)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None if i == -(1 << 63) else i for i in ids], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(map(written, own[:-1]), pa.string()),
                    pa.array(map(written, new), pa.string()),
                    pa.array([resemblance(x, y, k) for x, y in zip(own, new, strict=False)], pa.float64()),
                    pa.array([resemblance(x, y, k) for x, y in zip(own, own[1:], strict=False)], pa.float64()),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

        for batch in batches:
            for piece in chunks(batch):
                for r, doc_id, text, sentinel in zip(*(piece.column(c).to_pylist() for c in ("run", "doc_id", "text", "sentinel")), strict=True):
                    if r != run:
                        held, run, ended = [], r, False
                    if ended:
                        continue
                    held.append((doc_id, sentinel, text))
                    if sentinel:
                        ended = True
                        yield close([x[2] for x in held], [x[0] for x in held[:-1]])
                        held = []
                if len(held) > 1:
                    yield close([x[2] for x in held], [x[0] for x in held[:-1]])
                    held = held[-1:]

    return in_order(docs, ranges).select("run", "doc_id", "text", "sentinel").mapInArrow(rows, schema)
