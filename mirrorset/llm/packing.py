"""Token sequences of a fixed capacity, filled by best fit and a swap-based local search.

Documents are encoded where they are read; those longer than the capacity are cut into
whole pieces and one rest. The rests are dealt out evenly to groups of about ``group``
pieces, whole pieces to groups of their own, so that no task holds more. Each group is
packed on its own: best fit, largest first, then a local search over its underfull
bins. One-for-one swaps, two-for-one swaps and moves are made only if they raise the
sum of squared fills, until small bins run empty and go, or the group has no more bins
than it must have: by its tokens, by items over half of the capacity, which share no bin, and by
items over a third, of which two share one at most. Bins of equal sizes are tried once.

Null text is empty (its document is the end id alone), repeated rows are packed one by
one, an empty table gives no pieces, other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import KEPT_BYTES, encoder
from .staging import chunks, staged, tidy

#: Bytes that a lean worker remembers words in.
LEAN_BYTES = 48 << 20
#: Whole pieces in a group.
WHOLE = 1024
PIECE = "doc_id long, piece int, start long, length int, id_bytes int, ids binary, grp long"
PLACED = "doc_id long, piece int, start long, length long, id_bytes int, ids binary, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, groups: int, lean: bool = False) -> DataFrame:
    """Pieces of every document, with ids and the group that packs them.

    An executor's tasks take turns over all of its workers, and each of them remembers words; with ``lean`` they remember fewer,
    and none after their task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(tokenizer, "drop", LEAN_BYTES if lean else KEPT_BYTES)
        width = run.dtype.itemsize
        end = np.array([end_id], run.dtype).tobytes()
        task = TaskContext.get().partitionId()
        dealt, whole = task * 7919, 0
        for batch in batches:
            for part in chunks(batch):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "id_bytes", "ids", "grp")}
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), run.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    packed = ids + end
                    for k, at in enumerate(range(0, len(packed), capacity * width)):
                        piece = packed[at : at + capacity * width]
                        n = len(piece) // width
                        if n < capacity:
                            dealt += 1
                            grp = dealt % groups
                        else:
                            grp = groups + (task << 20) + whole // WHOLE
                            whole += 1
                        for name, x in zip(out, (doc_id, k, at // width, n, width, piece, grp), strict=True):
                            out[name].append(x)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], list(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut) if lean else cut, PIECE)


def fewest(sizes: list[int], capacity: int) -> int:
    """Bins that these sizes need at least."""
    large = sorted((s for s in sizes if 2 * s > capacity), reverse=True)
    middle = sorted(s for s in sizes if 3 * s > capacity >= 2 * s)
    beside = 0  # the least room left takes the smallest of the middle items
    for s in large:
        if beside < len(middle) and s + middle[beside] <= capacity:
            beside += 1
    return max(-(-sum(sizes) // capacity), len(large) + -(-(len(middle) - beside) // 2))


class Bins:
    """Bins of one group: item numbers by bin, their fill, and the bins in order of fill."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Largest first, each to the fullest bin that takes it."""
        by_fill: list[tuple[int, int]] = []
        for item in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[item]
            at = bisect.bisect_right(by_fill, (self.capacity - size, len(self.fill))) - 1
            if at >= 0:
                fill, b = by_fill.pop(at)
                self.items[b].append(item)
            else:
                fill, b = 0, len(self.fill)
                self.items.append([item])
                self.fill.append(0)
            self.fill[b] = fill + size
            bisect.insort(by_fill, (self.fill[b], b))

    def improve(self) -> None:
        """Empty the emptiest bins by steps that raise the sum of squared fills.

        A step puts more into a bin that is at least as full as the source: a move of one item or two, one of the source's
        items for a smaller one, one for two that are smaller together, or two for one that is smaller. All items of both
        bins are looked at; of bins with the same sizes one stands for all. It ends when a round over all underfull bins changes
        nothing, or when there are as many bins as the items need at least.
        """
        least = fewest(self.sizes, self.capacity)
        used = sum(1 for x in self.fill if x)
        sets = [self._sums(b) for b in range(len(self.fill))]
        fill, low = np.array(self.fill, np.int64), np.array([min((self.sizes[i] for i in x), default=0) for x in self.items], np.int64)
        version = np.zeros(len(fill), np.int64)
        kinds: dict[tuple[int, ...], int] = {}
        kind = np.array([self._kind(b, kinds) for b in range(len(self.fill))], np.int64)
        done: dict[int, int] = {}  # by kind of source: when no step was left for it
        seen: dict[int, tuple[int, int]] = {}
        clock, changed = 0, True
        while changed and used > least:
            changed = False
            open_bins = np.flatnonzero((fill > 0) & (fill < self.capacity))
            for source in open_bins[np.argsort(fill[open_bins], kind="stable")].tolist():
                own, at = seen.get(source, (-1, -1))
                since = at if own == version[source] else -1
                while fill[source] and used > least and done.get(int(kind[source])) != clock:
                    most = sum(sorted((self.sizes[i] for i in self.items[source]))[-2:])
                    room = self.capacity - fill
                    able = (room > 0) & (fill >= fill[source]) & ((low < most) | (room >= low[source])) & (version > since)
                    able[source] = False
                    targets = np.flatnonzero(able)[np.argsort(fill[able], kind="stable")]
                    firsts = np.sort(np.unique(kind[targets], return_index=True)[1])
                    step = next((t for t in targets[firsts].tolist() if self._step(source, t, sets)), None)
                    if step is None:
                        done[int(kind[source])] = clock
                        break
                    clock += 1
                    changed, since = True, -1
                    for b in (source, step):
                        sets[b], fill[b], version[b], kind[b] = self._sums(b), self.fill[b], clock, self._kind(b, kinds)
                        low[b] = min((self.sizes[i] for i in self.items[b]), default=0)
                    used -= not fill[source]
                seen[source] = (int(version[source]), clock)

    def _kind(self, b: int, kinds: dict[tuple[int, ...], int]) -> int:
        """A number for the sizes in a bin."""
        return kinds.setdefault(tuple(sorted(self.sizes[i] for i in self.items[b])), len(kinds))

    def _sums(self, b: int) -> tuple[list[int], int, int]:
        """Sizes in a bin, and the sums of one item and of two as bits of a number."""
        count = Counter(self.sizes[i] for i in self.items[b])
        one = sum(1 << s for s in count)
        two = before = 0
        for s, n in count.items():
            two |= (before << s) | ((1 << 2 * s) if n > 1 else 0)
            before |= 1 << s
        return sorted(count), one, two

    def _step(self, source: int, target: int, sets: list[tuple[list[int], int, int]]) -> bool:
        room = self.capacity - self.fill[target]
        (mine, _, my_pairs), (theirs, one, pairs) = sets[source], sets[target]
        best = (0, 0, 0, 0)  # gain, sum given, sum taken, 2 where two are given
        back = 1 | one | pairs
        for size in mine:
            least = max(0, size - room)
            left = back >> least
            take = least + (left & -left).bit_length() - 1
            if left and size - take > best[0]:
                best = (size - take, size, take, 1)
        for take in (0, *theirs):
            size = (my_pairs & ((1 << take + room + 1) - 1)).bit_length() - 1
            if size - take > best[0]:
                best = (size - take, size, take, 2)
        gain, size, take, n = best
        if not gain:
            return False
        out = self._items_of(source, size, n)
        into = self._items_of(target, take, 1 if one >> take & 1 else 2) if take else []
        self.items[source] = [i for i in self.items[source] if i not in out] + into
        self.items[target] = [i for i in self.items[target] if i not in into] + out
        self.fill[source] -= gain
        self.fill[target] += gain
        return True

    def _items_of(self, b: int, size: int, n: int) -> list[int]:
        """One item of a bin, or two, of this size together."""
        if n == 1:
            return [next(i for i in self.items[b] if self.sizes[i] == size)]
        met: dict[int, int] = {}
        for i in self.items[b]:
            if size - self.sizes[i] in met:
                return [met[size - self.sizes[i]], i]
            met[self.sizes[i]] = i
        raise ValueError(size)

    def packed(self) -> list[list[int]]:
        return [x for x in self.items if x]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.improve()
    return bins.packed()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, group: int = 8192, lean: bool = False) -> DataFrame:
    """Pieces with their ids, sequence_id and offset: a sequence is its pieces' ids in order of offset.

    ``lean`` is for executors whose memory other stages have filled; it takes more time and disk, and gives the same pieces.
    """
    groups = max(1, round(docs.count() / group))
    pieces = token_pieces(docs, tokenizer, end_id, capacity, groups, lean)
    if lean:  # written first: workers get small batches meanwhile
        pieces = staged(pieces, "pieces")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows["length"].tolist()
        for b, items in enumerate(pack(lengths, capacity)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = b, at
                at += lengths[i]
        rows["sequence_id"] = (key[0] << 20) + sequence
        rows["offset"] = offset
        return rows[[c.split()[0] for c in PLACED.split(", ")]]

    return pieces.groupBy("grp").applyInPandas(place, PLACED)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """ids_crc32: unsigned crc32 of the ids as little-endian unsigned 32-bit numbers; the ids themselves go."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True)
            crc = pa.array([zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([crc if c == "ids_crc32" else batch.column(c) for c in columns], columns)

    return pieces.mapInArrow(digest, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
