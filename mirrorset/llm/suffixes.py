"""Repeated byte strings, by a logarithmic family of suffix arrays.

A byte is removed if a string of ``MATCH`` bytes that covers it also starts earlier:
in a smaller document, or in the same one further left.

1. Every window of ``MATCH`` bytes has an anchor that depends on its bytes alone
   (``bytesets.anchor_runs``). Sorted blocks of anchor keys are merged by key range: only
   windows whose key occurs twice can repeat. Of runs with equal bytes (64 bits of key
   and 48 of a digest) the first goes on and the others are marked, in each block and then in
   each range, so a passage held by a third of all documents gives a merge one entry a block.
2. Runs whose key has several surroundings, with their bytes, are dealt out by key to
   buckets of bounded size. A key with more than ``HOT`` different surroundings is dealt out window by window instead, by
   the hash of the window, after equal windows were reduced to the first.
3. ``SuffixFamily`` takes the windows in batches of ascending documents. In each bucket a
   batch gets its suffix array (window starts in order of their ``MATCH`` bytes), which is
   merge-scanned against the suffix arrays of the levels: an equal neighbour starts earlier.
   What is new becomes a level; levels of equal size merge.

In the family bytes are compared as they are. Levels, batches and stages are written tables.

Null text is empty and nothing repeats in it, texts under ``MATCH`` bytes keep all, a
copy of an earlier text of at least ``MATCH`` bytes goes whole, rows of one doc_id
are different documents in order of a text hash, null doc_id comes first, an empty table
gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import MATCH, anchor_runs
from .staging import chunks, numbered, planes, release_memory, staged, tidy, unplaned, utf8

#: Anchors sorted at a time in a task, rows of a bucket, surroundings of a key.
BLOCK, BUCKET, HOT = 400_000, 4096, 4096
BATCHES = 4
#: Bytes of surroundings that a task remembers.
KEPT_BYTES = 64 << 20
BLOCK_ROW = "part int, known boolean, keys binary, digests binary, docs binary, firsts binary, counts binary"
LEVEL_ROW = "bucket int, text binary, suffixes binary"
SCAN_ROW = "kind int, bucket int, doc long, begin long, end long, text binary, suffixes binary"


def repeated_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """By document: ``__firsts``, the runs whose key other bytes have too; ``__marks``, runs (first * 128 + count) of known bytes.

    Of equal runs only the first is looked at further: all windows of the others repeat it.
    """

    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            release_memory()
            columns, new = in_order(columns)
            keys = columns[0][new]
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
            rows = [(p, False, *(planes(c[new[a:b]]) for c in columns)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            known = np.delete(np.arange(len(columns[0])), new)
            for a in range(0, len(known), 50_000):
                at = known[a : a + 50_000]
                rows.append((int(columns[0][at[0]] % np.uint64(parts)), True, b"", b"", *(planes(c[at]) for c in columns[2:])))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows[i : i + 64], columns=[c.split()[0] for c in BLOCK_ROW.split(", ")]).astype({"part": "int32"}), preserve_index=False)

        for batch in batches:
            for piece in chunks(batch):
                ids = piece.column("__doc").to_numpy()
                for number, first, count, keys, digest in anchor_runs(utf8(piece.column("text"))):
                    held.append((keys, digest >> np.uint64(16), ids[number], first.astype(np.uint32), count.astype(np.uint8)))
                if sum(len(x[0]) for x in held) >= BLOCK:
                    yield from close()
        if held:
            yield from close()

    def in_order(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Sorted by key, digest, document and place; where a new run of bytes begins."""
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        keys, digests = columns[:2]
        return columns, np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1])]))

    @tidy
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task takes several key ranges one after the other: rows come sorted by range
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["known"]:
                    docs_, firsts, counts = (unplaned(row[c], kind) for c, kind in (("docs", "<i8"), ("firsts", "<u4"), ("counts", "<u1")))
                    yield by_document(docs_, firsts.astype(np.int64) * 128 + counts, "__marks")
                    continue
                if row["part"] != now and held:
                    yield from matched(held)
                    held = []
                now = row["part"]
                held.append(row)
        if held:
            yield from matched(held)

    def matched(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        kinds = {"keys": "<u8", "digests": "<u8", "docs": "<i8", "firsts": "<u4", "counts": "<u1"}
        (keys, _, docs_, firsts, counts), new = in_order([np.concatenate([unplaned(r[c], kind) for r in rows]) for c, kind in kinds.items()])
        firsts = firsts.astype(np.int64)
        known = np.ones(len(keys), bool)
        known[new] = False
        if known.any():
            yield by_document(docs_[known], firsts[known] * 128 + counts[known], "__marks")
        heads = keys[new]
        same = heads[1:] == heads[:-1]
        several = new[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if len(several):
            yield by_document(docs_[several], firsts[several], "__firsts")

    def by_document(docs_: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
        order = np.lexsort((values, docs_))
        docs_, values = docs_[order], values[order]
        new = np.flatnonzero(np.concatenate([[True], docs_[1:] != docs_[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(docs_)), pa.int32()), pa.array(values))
        none = pa.nulls(len(new), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(docs_[new]), *(lists if c == name else none for c in ("__firsts", "__marks"))], ["__doc", "__firsts", "__marks"])

    sent = docs.select("__doc", F.col("text").cast("string").alias("text")).mapInArrow(blocks, BLOCK_ROW)
    meet = sent.repartitionById(parts, "part").sortWithinPartitions("part")
    lists = meet.mapInArrow(merged, "__doc long, __firsts array<bigint>, __marks array<bigint>")
    return lists.groupBy("__doc").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("__firsts", "__marks")))


RUN_ROW = "kind int, key long, doc long, begin long, n long, end long, text binary"


class _Firsts:
    """The first occurrence of byte strings in a task; within a bound, later ones are marked here and go no further."""

    def __init__(self) -> None:
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.held = 0
        self.out: list[tuple] = []

    def add(self, key: int, doc: int, begin: int, n: int, run: bytes) -> None:
        new = (doc, begin)
        at = self.seen.setdefault(run, new)
        if at is not new:
            late = max(at, new)
            self.out.append((1, None, *late, n, late[1] + n + MATCH - 1, None))
            if late is new:
                return
            self.seen[run] = new
        self.out.append((0, key, doc, begin, n, None, run))
        self.held += len(run) + 200
        if self.held > KEPT_BYTES:
            self.seen.clear()
            self.held = 0

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return run_rows(out)


def run_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in RUN_ROW.split(", ")])


def surroundings(suspects: DataFrame) -> DataFrame:
    """The bytes of each run in ``__firsts``: kind 0, key, doc, begin, n (windows), text."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                texts, ids = utf8(piece.column("text")), piece.column("__doc").to_pylist()
                wanted = [np.array(x, np.int64) for x in piece.column("__firsts").to_pylist()]
                out = []
                for numbers, firsts, counts, keys, _ in anchor_runs(texts):
                    for i in np.unique(numbers).tolist():
                        own = np.arange(*np.searchsorted(numbers, [i, i + 1]))
                        own = own[np.isin(firsts[own], wanted[i])]
                        text, doc = texts[i], ids[i]
                        for a, n, key in zip(firsts[own].tolist(), counts[own].tolist(), keys[own].view(np.int64).tolist(), strict=True):
                            out.append((0, key, doc, a, n, None, text[a : a + n + MATCH - 1]))
                yield run_rows(out)

    return suspects.where(F.size("__firsts") > 0).select("__doc", "text", "__firsts").mapInArrow(rows, RUN_ROW)


def single_windows(runs: DataFrame) -> DataFrame:
    """Each window of a run as a run of its own, with the hash of its bytes as key."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts_ = _Firsts()
        for batch in batches:
            for row in batch.to_pylist():
                for i in range(row["n"]):
                    window = row["text"][i : i + MATCH]
                    key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                    firsts_.add(key, row["doc"], row["begin"] + i, 1, window)
            yield firsts_.rows()

    return runs.mapInArrow(rows, RUN_ROW)


def without_hot_keys(rows: DataFrame) -> DataFrame:
    """Runs of keys with more than ``HOT`` surroundings become single windows, all others stay."""
    runs = rows.where("kind = 0")
    hot = runs.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT).select("key", F.lit(True).alias("__hot"))
    hot = staged(hot, "hot-keys")
    if not (n := hot.count()):
        return rows
    marked = rows.join(F.broadcast(hot) if n <= 100_000 else hot, "key", "left")
    columns = [c.split()[0] for c in RUN_ROW.split(", ")]
    return staged(marked.where("__hot is null").select(columns).unionByName(single_windows(marked.where("__hot").select(columns))), "dealt-runs")


def suffix_keys(text: bytes, begins: np.ndarray) -> np.ndarray:
    """The ``MATCH`` bytes at each place; a last byte of 1 keeps numpy from cutting zero bytes off."""
    if not len(begins):
        return np.zeros(0, f"S{MATCH + 1}")
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), MATCH)
    out = np.ones((len(begins), MATCH + 1), np.uint8)
    out[:, :MATCH] = view[begins]
    return out.view(f"S{MATCH + 1}").ravel()


def merge_scan(older: np.ndarray, newer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of two sorted runs of keys put together (older first among equals), and which entries equal the one before."""
    keys = np.concatenate([older, newer])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.concatenate([[False], keys[1:] == keys[:-1]]) if len(keys) else np.zeros(0, bool)


def scan_batch(rows: pd.DataFrame, levels: list[tuple[bytes, np.ndarray]]) -> tuple[list[tuple[int, int, int]], bytes, np.ndarray]:
    """Marked spans of a batch's runs, and its level: text and the suffixes that no level has.

    ``rows`` (doc, begin, n, text) are in order of doc and begin.
    """
    text, n = b"".join(rows["text"]), rows["n"].to_numpy()
    sizes = n + MATCH - 1
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    places = base[row] + inside
    keys = suffix_keys(text, places)
    order = np.argsort(keys, kind="stable")
    again = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    heads = np.flatnonzero(~again)
    family = np.cumsum(~again) - 1
    known = np.zeros(len(heads), bool)
    for level_text, suffixes in levels:
        merged, equal = merge_scan(suffix_keys(level_text, suffixes), keys[order[heads]])
        mine = merged >= len(suffixes)
        known[merged[mine & equal] - len(suffixes)] = True
    repeated = np.empty(len(row), bool)
    repeated[order] = again | known[family]
    new_run = repeated & ~(np.concatenate([[False], repeated[:-1]]) & (inside > 0))
    last_run = repeated & ~np.concatenate([(inside[1:] > 0) & repeated[1:], [False]])
    begins, ends = np.flatnonzero(new_run), np.flatnonzero(last_run)
    doc, first = rows["doc"].to_numpy(), rows["begin"].to_numpy()
    spans = [(doc[row[a]], first[row[a]] + inside[a], first[row[b]] + inside[b] + MATCH) for a, b in zip(begins, ends, strict=True)]
    return spans, text, places[order[heads[~known]]].astype(np.int32)


class SuffixFamily:
    """Levels of suffix arrays over the batches so far; a level counts the batches in it.

    A batch holds runs (bucket, doc, begin, n, text) whose documents come after those of the batches before.
    Before a batch is scanned, levels of equal size merge, newest first, so there are about as many levels as the
    number of batches has binary digits.
    """

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[int, DataFrame]] = []

    def settle(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (newer_size, newer), (older_size, older) = self.levels.pop(), self.levels.pop()
            both = older.withColumn("age", F.lit(0)).unionByName(newer.withColumn("age", F.lit(1)))
            self.levels.append((older_size + newer_size, staged(both.groupBy("bucket").applyInPandas(self._merge, LEVEL_ROW), "suffix-level")))

    @staticmethod
    def _merge(rows: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        rows = rows.sort_values("age")
        text, suffixes = rows["text"].iloc[0], np.frombuffer(rows["suffixes"].iloc[0], np.int32)
        for more, places in zip(rows["text"].iloc[1:], rows["suffixes"].iloc[1:], strict=True):
            places = np.frombuffer(places, np.int32)
            order, equal = merge_scan(suffix_keys(text, suffixes), suffix_keys(more, places))
            suffixes = np.concatenate([suffixes, places + np.int32(len(text))])[order[~equal]]
            text += more
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "text": [text], "suffixes": [suffixes.tobytes()]})

    def add(self, batch: DataFrame) -> DataFrame:
        """Marked spans (doc, begin, end) of a batch, which then is the newest level."""
        self.settle()
        rows = batch.select("bucket", F.lit(-1).alias("age"), "doc", "begin", "n", "text", F.lit(None).cast("binary").alias("suffixes"))
        for age, (_, level) in enumerate(self.levels):
            gap = [F.lit(None).cast("long").alias(c) for c in ("doc", "begin", "n")]
            rows = rows.unionByName(level.select("bucket", F.lit(age).alias("age"), *gap, "text", "suffixes"))

        def scan(rows: pd.DataFrame) -> pd.DataFrame:
            release_memory()
            own = rows[rows["age"] < 0].sort_values(["doc", "begin"])
            out = []
            if len(own):
                levels = [(t, np.frombuffer(s, np.int32)) for t, s in zip(rows["text"][rows["age"] >= 0], rows["suffixes"][rows["age"] >= 0], strict=True)]
                own = own.astype({"doc": "int64", "begin": "int64", "n": "int64"})
                bucket = own["bucket"].iloc[0]
                spans, text, suffixes = scan_batch(own, levels)
                out = [(1, bucket, *x, None, None) for x in spans]
                out.append((0, bucket, None, None, None, text, suffixes.tobytes()))
            return pd.DataFrame(out, columns=[c.split()[0] for c in SCAN_ROW.split(", ")])

        scanned = staged(rows.groupBy("bucket").applyInPandas(scan, SCAN_ROW), "suffix-scan")
        self.levels.append((1, scanned.where("kind = 0").select("bucket", "text", "suffixes")))
        return scanned.where("kind = 1").select("doc", "begin", "end")


def repeated_spans(suspects: DataFrame) -> DataFrame:
    """(doc, spans): the merged spans of each suspect document (``__doc``, text, ``__firsts``, ``__marks``) that repeat earlier bytes."""
    rows = without_hot_keys(staged(surroundings(suspects), "runs"))
    facts = rows.where("kind = 0").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc", [i / BATCHES for i in range(1, BATCHES)]).alias("cuts")).first()
    buckets = max(1, -(-facts["n"] // BUCKET))
    family = SuffixFamily(suspects.sparkSession, buckets)
    runs = rows.where("kind = 0").withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    known = suspects.select(F.col("__doc").alias("doc"), F.explode("__marks").alias("m"))
    known = known.select("doc", F.expr("m div 128").alias("begin"), F.expr(f"m div 128 + m % 128 + {MATCH - 1}").alias("end"))
    spans = known.unionByName(rows.where("kind = 1").select("doc", "begin", "end"))
    cuts = sorted(set(facts["cuts"] or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = runs
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        spans = spans.unionByName(family.add(batch))
    lists = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("all"))

    def join(state, x):
        last = F.element_at(state, -1)
        grown = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(last["end"] >= x["begin"], grown).otherwise(F.concat(state, F.array(x)))

    return lists.select("doc", F.aggregate("all", F.slice("all", 1, 1), join).alias("spans"))


def mark_repeats(docs: DataFrame, slim: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Add ``__spans``, the byte spans [begin, end) to remove, to each document; they are in order and do not touch.

    ``slim`` may shorten the rows of documents without ``__firsts`` before the table is staged.
    """
    docs = numbered(docs)
    parts = max(8, 2 * docs.select("text").rdd.getNumPartitions())
    joined = docs.join(repeated_anchors(docs, parts), "__doc", "left")
    table = staged(slim(joined), "suspects")
    suspects = table.where("__firsts is not null")
    spans = repeated_spans(suspects).withColumnRenamed("doc", "__doc").withColumnRenamed("spans", "__spans")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    calm = table.where("__firsts is null").withColumn("__spans", none)
    return suspects.join(spans, "__doc", "left").withColumn("__spans", F.coalesce("__spans", none)).unionByName(calm).drop("__firsts", "__marks")


def kept_bytes(text, spans):
    """The bytes of a text outside its spans."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    ends = F.concat(F.transform(spans, lambda x: x["begin"]), F.array(F.octet_length(data).cast("long")))
    gaps = F.zip_with(begins, ends, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")))
    return F.aggregate(gaps, F.lit(b""), lambda out, x: F.concat(out, x))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut out of their texts, as far as these are whole characters; n_chars follows.

    Null text stays null. Columns that begin with two underscores are used in between.
    """
    names = docs.columns
    marked = mark_repeats(docs.withColumn("text", F.col("text").cast("string")))
    schema = marked.select(*names).schema

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if text is not None and spans:
                    data, out, at = text.encode(), [], 0
                    for span in spans:
                        begin, end = span["begin"], span["end"]
                        while begin < end and data[begin] & 0xC0 == 0x80:
                            begin += 1
                        while begin < end < len(data) and data[end] & 0xC0 == 0x80:
                            end -= 1
                        out.append(data[at:begin])
                        at = end
                    text = b"".join([*out, data[at:]]).decode()
                texts.append(text)
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    out = marked.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
