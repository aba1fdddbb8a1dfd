"""Near-duplicate documents by a parity-sketch join over word shingles.

Two documents link when the intersection of their shingle sets is at least 75 % of the
union. Then their symmetric difference is at most a seventh of the sum of their sizes.

* Sketch. A band holds the sizes from one power of two to the next. In a band every set
  is hashed into ``m`` words: each shingle flips random bits of one word, its part by hash, so a
  word is the XOR of its shingles. A shingle that only one set holds changes one word, so
  the number of differing words is a lower bound of the symmetric difference D. A set
  joins the band of its size, and the next one if a partner may be that large.
* Pigeonhole. Of the first D + 1 words that are not empty, in any order that all
  sets share, one at least is equal in both. Words of frequent shingles come last in that
  order, which keeps common passages out of the join. Sorted blocks of word keys
  are merged by key range.
* Groups. Sets that meet in a group of at most ``SMALL`` make pairs. Larger groups make a star
  and a chain; the pairs left out are looked at once components are known, and only where
  a group still holds different ones. Such a group is dealt out to cells of bounded size,
  and only pairs that the parity sketches let pass leave a cell.
* Check. A parity sketch of one bit a shingle is compared first: its Hamming distance
  bounds the symmetric difference from below. What passes is counted on the whole sets.

A set may have fewer than D + 1 words with a chance under 1e-12 (``m`` leaves a third of
them spare); sets are compared by 64-bit hashes of shingles.

Equal sets are one class, represented by its smallest document; so a text copied many
times is joined once. Null, empty and wordless texts have empty sets and no links, rows
of one doc_id are different documents, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import mixed, shingle_sets
from .graph import components
from .staging import chunks, numbered, planes, release_memory, staged, tidy, unplaned, utf8

#: Documents of a block in which a shingle must occur to be reported, and in all to count as frequent; how many are kept.
FREQUENT_HERE, FREQUENT, FREQUENT_KEPT = 2, 32, 1_000_000
#: Words sorted at a time in a task; sets of a group that makes all its pairs, and of a cell of a larger one; ids that are broadcast at most.
BLOCK, SMALL, CELL, BROADCAST_IDS = 400_000, 8, 512, 1_000_000


def links(a: int, b: int, both: int) -> bool:
    """100 * intersection >= 75 * union."""
    return 100 * both >= 75 * (a + b - both)


def words_of(band: int) -> int:
    """Words of a sketch in a band: more than the largest difference; small sets get about a word a shingle."""
    if band < 6:
        return 1 << 20
    most = 2 * ((2 << band) - 1) // 7
    return -(-13 * (most + 1) // 10) + 20


def word_keys(hashes: np.ndarray, frequent: np.ndarray) -> list[np.ndarray]:
    """The word keys of a set, for each band it joins: D + 1 words, frequent shingles last."""
    n = len(hashes)
    own = n.bit_length() - 1
    at = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
    hot = frequent[at] == hashes if len(frequent) else np.zeros(n, bool)
    kinds = [hashes[~hot], hashes[hot]]
    out = []
    for band in (own, own + 1):
        largest = min(4 * n // 3, (2 << band) - 1)
        if largest < 1 << band:
            continue
        wanted, m, keys = (n + largest) // 7 + 1, np.uint64(words_of(band)), []
        for kind, own_hashes in enumerate(kinds):
            if len(own_hashes) and sum(map(len, keys)) < wanted:
                word = (own_hashes >> np.uint64(32)) * m >> np.uint64(32)
                heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                parity = np.bitwise_xor.reduceat(mixed(own_hashes), heads)
                keys.append(mixed(parity ^ mixed(word[heads] * np.uint64(256) + np.uint64(band * 2 + kind))))
        out.append(np.concatenate(keys)[:wanted])
    return out


def parity_bits(hashes: np.ndarray) -> bytes:
    """One bit a shingle, flipped: a power of two of bits, at least twice the size. Halves fold by XOR."""
    bits = max(8, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((mixed(hashes ^ np.uint64(0x5EED)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two parity sketches at the length of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, n), axis=0), np.bitwise_xor.reduce(y.reshape(-1, n), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def facts(docs: DataFrame) -> DataFrame:
    """kind 0: a document's set (doc, n, two digests a, b of the set); kind 1: a shingle frequent in a block (a, n documents)."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        names = ["kind", "doc", "n", "a", "b"]

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT_HERE
            values, counts = values[often], counts[often]
            held.clear()
            release_memory()
            seen.clear()
            zero = np.zeros(len(values), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(zero + 1), pa.array(zero), pa.array(counts.astype(np.int64)), _signed(values), pa.array(zero)], names)

        for batch in batches:
            for piece in chunks(batch):
                sets = shingle_sets(utf8(piece.column("text")))
                spread = [mixed(x) for x in sets]
                a = np.array([x.sum(dtype=np.uint64) for x in spread], np.uint64)
                b = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in spread], np.uint64)
                n = np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(n * 0), piece.column("__doc"), pa.array(n), _signed(a), _signed(b)], names)
                for x, key in zip(sets, zip(a.tolist(), b.tolist(), strict=True), strict=True):
                    if len(x) and key not in seen:
                        seen.add(key)
                        held.append(x)
                if sum(map(len, held)) >= 2 * BLOCK:
                    yield frequent()
        if held:
            yield frequent()

    return docs.select("__doc", F.col("text").cast("string").alias("text")).mapInArrow(rows, "kind long, doc long, n long, a long, b long")


def only(docs: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join on ``__doc``; the ids are broadcast if they are few."""
    ids = ids.select(F.col(column).alias("__doc"))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "__doc", how)


def candidates(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """kind 0: a pair (a, b) and the words they share; kind 1: a member (doc a, size b) of a large group (key)."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []

        def close() -> Iterator[pa.RecordBatch]:
            counts = [len(x[0]) for x in held]
            keys = np.concatenate([x[0] for x in held])
            docs_ = np.repeat(np.array([x[1] for x in held], np.int64), counts)
            sizes = np.repeat(np.array([x[2] for x in held], np.uint32), counts)
            held.clear()
            release_memory()
            order = np.argsort(keys)
            keys, docs_, sizes = keys[order], docs_[order], sizes[order]
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
            rows = [(p, planes(keys[a:b]), planes(docs_[a:b]), planes(sizes[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows[i : i + 64], columns=["part", "keys", "docs", "sizes"]).astype({"part": "int32"}), preserve_index=False)

        total = 0
        for batch in batches:
            for piece in chunks(batch):
                for doc, hashes in zip(piece.column("__doc").to_pylist(), shingle_sets(utf8(piece.column("text"))), strict=True):
                    if len(hashes):
                        for keys in word_keys(hashes, known.value):
                            held.append((keys, doc, len(hashes)))
                            total += len(keys)
                if total >= BLOCK:
                    yield from close()
                    total = 0
        if held:
            yield from close()

    @tidy
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now and held:
                    yield from meet(held)
                    held = []
                now = row["part"]
                held.append(row)
        if held:
            yield from meet(held)

    def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([unplaned(r["keys"], "<u8") for r in rows])
        docs_ = np.concatenate([unplaned(r["docs"], "<i8") for r in rows])
        sizes = np.concatenate([unplaned(r["sizes"], "<u4") for r in rows]).astype(np.int64)
        order = np.argsort(keys)
        order = order[repeated(keys[order])]
        order = order[np.lexsort((docs_[order], keys[order]))]
        keys, docs_, sizes = keys[order], docs_[order], sizes[order]
        if not len(keys):
            return
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(heads, len(keys)))
        group, pivot = np.repeat(counts, counts), np.repeat(heads, counts)
        lefts, rights = [], []
        for d in range(1, SMALL):
            same = np.flatnonzero((keys[d:] == keys[:-d]) & ((group[d:] <= SMALL) | (d == 1)))
            lefts.append(same)
            rights.append(same + d)
        star = np.flatnonzero((group > SMALL) & (np.arange(len(keys)) > pivot + 1))
        left, right = np.concatenate([*lefts, pivot[star]]), np.concatenate([*rights, star])
        fits = 4 * np.minimum(sizes[left], sizes[right]) >= 3 * np.maximum(sizes[left], sizes[right])
        left, right = docs_[left[fits]], docs_[right[fits]]
        left, right = left[left != right], right[left != right]
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(left)))
        large = group > SMALL
        yield rows_of(0, np.zeros(len(new), np.int64), left[new], right[new], times)
        yield rows_of(1, keys[large].view(np.int64), docs_[large], sizes[large], np.ones(int(large.sum()), np.int64))

    def rows_of(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key), pa.array(a), pa.array(b), pa.array(n)], ["kind", "key", "a", "b", "n"])

    sent = docs.select("__doc", F.col("text").cast("string").alias("text")).mapInArrow(blocks, "part int, keys binary, docs binary, sizes binary")
    return sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(merged, "kind long, key long, a long, b long, n long")


def repeated(keys: np.ndarray) -> np.ndarray:
    same = keys[1:] == keys[:-1]
    out = np.zeros(len(keys), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def sets_of(docs: DataFrame) -> DataFrame:
    """doc, size, parity sketch and sorted hashes of each document."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                sets = shingle_sets(utf8(piece.column("text")))
                columns = [piece.column("__doc"), pa.array([len(x) for x in sets]), pa.array(map(parity_bits, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "size", "bits", "hashes"])

    return docs.select("__doc", F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc long, size long, bits binary, hashes binary")


def _with(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc").alias(side), F.col("size").alias(f"size_{side}"), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def _passing(pairs: DataFrame, column: str, test) -> DataFrame:
    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("size_a", "size_b", f"{column}_a", f"{column}_b")]
            good = pa.array([test(*(x.as_py() for x in row)) for row in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(["a", "b", "n"]).filter(good)

    return pairs.select("a", "b", "n", "size_a", "size_b", f"{column}_a", f"{column}_b").mapInArrow(rows, "a long, b long, n long")


def near_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose parity sketches allow a link."""
    return _passing(_with(pairs, sets, "bits"), "bits", lambda m, n, a, b: 7 * hamming(a, b) <= m + n)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that link, counted on the whole sets."""

    def test(m: int, n: int, a: bytes, b: bytes) -> bool:
        return links(m, n, len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)))

    return _passing(_with(pairs, sets, "hashes"), "hashes", test).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """__doc, n_shingles and __label (the smallest ``__doc`` of its component) of documents that ``numbered`` has numbered."""
    parts = max(8, 2 * docs.select("text").rdd.getNumPartitions())
    known = staged(facts(docs), "shingle-facts")
    often = known.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "a").limit(FREQUENT_KEPT).select("a").toPandas()["a"].to_numpy(np.int64)
    frequent = np.sort(often.view(np.uint64))
    sets = known.where("kind = 0").select("doc", "n", "a", "b")
    classes = sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows"))
    several = classes.where("rows > 1").drop("rows")
    copies = staged(sets.join(several, ["n", "a", "b"]).where("doc <> first").select("doc", "first"), "set-copies")
    singles = only(docs.select("__doc", "text"), copies, "doc", "left_anti")
    found = staged(candidates(singles, frequent, parts), "candidates")
    pairs = staged(found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    members = found.where("kind = 1").select("key", F.col("a").alias("doc"), F.col("b").alias("size"))
    ends = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).unionByName(members.select("doc")).distinct()
    own = staged(sets_of(only(docs.select("__doc", "text"), staged(ends, "ends"), "doc", "left_semi")), "sets")
    near = staged(near_enough(pairs, own), "near-pairs")
    sure = staged(linked(near, own), "links-found")
    labels = staged(components(sure), "labels")
    rest = apart_groups(members, labels, own)
    more = staged(linked(rest, own), "links-found")
    if more.take(1):
        labels = staged(components(sure.unionByName(more)), "labels")
    label = F.coalesce("label", "first", F.col("__doc"))
    seeds = sets.select(F.col("doc").alias("__doc"), F.col("n").alias("n_shingles")).join(copies.withColumnRenamed("doc", "__doc"), "__doc", "left")
    seeds = seeds.withColumn("doc", F.coalesce("first", "__doc")).join(labels, "doc", "left").select("__doc", "n_shingles", label.alias("__label"))
    return staged(seeds, "near-labels")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller one in their component; other columns stay as they are."""
    ordered = numbered(docs)
    others = near_duplicates(ordered).where("__doc <> __label").select(F.col("__doc").alias("doc"))
    return only(ordered, others, "doc", "left_anti").drop("__doc")


def apart_groups(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a large group that lie in different components and may link by size and parity sketch.

    Groups of the same documents count once. A group is dealt out to blocks of about ``CELL`` documents, and two
    blocks make a cell, so no task holds a whole group.
    """
    placed = members.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    groups = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("h"),
        F.min("doc").alias("low"),
        F.max("doc").alias("high"),
        F.count_distinct("label").alias("labels"),
    )
    different = groups.where("labels > 1").groupBy("n", "h", "low", "high").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    each = placed.join(different.select("key", blocks.alias("blocks")), "key").select("key", "doc", "label", "blocks")
    each = each.withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = each.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "doc", "label")
    cells = cells.join(sets.select("doc", "size", "bits"), "doc")

    columns = ["key", "x", "y", "mine", "doc", "label", "size"]

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # cells come one after the other; the rows of the last one wait for the next batch
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            key, x, y = (now.column(c).to_numpy() for c in columns[:3])
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            held = now.slice(new[-1])
            yield found_in(now, new)
        if held is not None:
            yield found_in(held, np.array([0, held.num_rows]))

    def found_in(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        _, x, y, mine, doc, label, size = (rows.column(c).to_numpy() for c in columns)
        bits = rows.column("bits").slice(0, int(cuts[-1])).to_pylist()
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            shortest = min(map(len, bits[a:b]))
            folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(k, np.uint8).reshape(-1, shortest), axis=0) for k in bits[a:b]])
            for i in range(a, b - 1):
                end = i + 1 + np.searchsorted(size[i + 1 : b], 4 * size[i] // 3, "right")
                others = np.arange(i + 1, end)
                others = others[(label[others] != label[i]) & ((x[i] == y[i]) | (mine[others] != mine[i]))]
                apart = np.bitwise_count(folded[others - a] ^ folded[i - a]).sum(axis=1, dtype=np.int64)
                out += [(min(doc[i], doc[j]), max(doc[i], doc[j])) for j in others[7 * apart <= size[others] + size[i]].tolist() if 7 * hamming(bits[i], bits[j]) <= size[i] + size[j]]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "size").select(*columns, "bits")
    found = dealt.mapInArrow(near, "a long, b long")
    return staged(found.distinct().withColumn("n", F.lit(1).cast("long")), "group-pairs")
