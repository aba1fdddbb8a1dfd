"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled to three machines: the normaliser (a dummy space in front, spaces
written as U+2581), a deterministic machine of pieces, and a byte fallback for characters that no
piece holds. A state of the piece machine is the longest end of the text read so far that begins a piece; its arcs
read a character, and it emits every piece that ends there, longest first. Composed with a text they make a lattice whose states
are (place, last piece). The best path in the tropical semiring is the encoding.

Weights. In a unigram model a piece costs its negative score. A merge model does not sum
scores, it merges the best neighbours first; there a piece costs 1 and the step from one piece
to the next costs nothing if merging both texts together leaves the two pieces as they are, and infinity
otherwise. A sequence of pieces is what merging gives exactly if all its neighbours are so,
hence one finite path is left and it is the model's own encoding.

Texts are cut where no piece reaches across: before a space that follows another
character, around line breaks, and between any two characters that no piece holds side by
side. Each part is composed once per worker and remembered within a bound.

Null and empty texts have no pieces and decode to the empty text. Long, repeated and
odd texts are like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import FORGET, chunks

SPACE = "▁"
INFINITY = float("inf")
LONGEST_KEPT = 48
# Piece and model types in model files.
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, MERGES = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a serialized message: whole numbers, floats, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = 4 if kind == 5 else 8
            at += n
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at - n : at])[0]


#: Bytes that a worker remembers words and parts of words in, and what an entry takes beside its characters and ids.
KEPT_BYTES, ENTRY_BYTES = 96 << 20, 200


class _Known(dict):
    """Packed ids by word, within a bound of bytes; a new word is composed when it is looked up."""

    def __init__(self, compose: Callable[[str], bytes], kept: int) -> None:
        super().__init__()
        self.compose, self.kept, self.held = compose, kept, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.compose(word)
        if len(word) <= LONGEST_KEPT:
            if self.held > self.kept:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += ENTRY_BYTES + 2 * len(word) + len(ids)
        return ids


class _Joins(dict):
    """Weights of steps between pieces by ``last << 20 | piece``; a new one is worked out when it is looked up."""

    def __init__(self, cost: Callable[[int, int], float]) -> None:
        super().__init__()
        self.cost = cost

    def __missing__(self, key: int) -> float:
        self[key] = out = self.cost(key >> 20, key & 0xFFFFF)
        return out


class Model:
    """Pieces of a model file; enough to decode."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        self.pieces, self.scores, self.types = [], [], []
        for number, value in top:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
        trainer = dict(_fields(dict(top)[2]))
        normaliser = dict(_fields(dict(top).get(3, b"")))
        self.merges = trainer.get(3, UNIGRAM) == MERGES
        self.prefix = bool(normaliser.get(3, 1))
        if normaliser.get(2) or normaliser.get(4, 1) or USER_DEFINED in self.types:
            raise ValueError("the normaliser must be the identity that keeps white space, without user-defined pieces")
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.written = [bytes([byte_of[i]]) if i in byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces put together, bytes as UTF-8, the dummy space taken off."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Transducer(Model):
    """The machines of a model, composed with texts; ``kept`` bounds the bytes of words it remembers."""

    def __init__(self, path: str, kept: int = KEPT_BYTES) -> None:
        super().__init__(path)
        self.unknown = self.types.index(UNKNOWN)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, UNUSED)}
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        if any(pair[1] == SPACE != pair[0] or "\n" in pair for pair in (pair for p in self.ids for pair in zip(p, p[1:], strict=False))):
            raise ValueError("a piece reaches across a space or a line break")
        self.pairs = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.weights = [1.0] * len(self.scores) if self.merges else [-x for x in self.scores]
        self.fallback_weight = 1.0 if self.merges else 10.0 - min(self.scores)
        self.compiled()
        self.known, self.known_parts = _Known(self._word_ids, kept // 2), _Known(self._part_ids, kept // 2)
        self.joins = _Joins(self.join_cost)
        self.histories: dict[int, list[tuple[float, str, str]]] = {}

    def compiled(self) -> None:
        """The piece machine: arcs by state, the state of the next shorter end, and the (piece, length) that end in a state."""
        self.arcs: list[dict[str, int]] = [{}]
        self.shorter, self.ending = [0], [()]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                to = self.arcs[state].get(c)
                if to is None:
                    to = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.shorter.append(0)
                    self.ending.append(())
                state = to
            self.ending[state] = ((i, len(piece)),)
        layer = list(self.arcs[0].values())
        while layer:
            following = []
            for state in layer:
                self.ending[state] += self.ending[self.shorter[state]]
                for c, to in self.arcs[state].items():
                    self.shorter[to] = self._next(self.shorter[state], c)
                    following.append(to)
            layer = following

    def _next(self, state: int, c: str) -> int:
        while c not in self.arcs[state]:
            if not state:
                return 0
            state = self.shorter[state]
        return self.arcs[state][c]

    def history(self, i: int) -> list[tuple[float, str, str]]:
        """The merges that make a piece: score, and the leftmost and rightmost symbol after each."""
        if i not in self.histories:
            if len(self.histories) >= 8000:
                self.histories.clear()
            symbols, out = list(self.pieces[i]), []
            out.append((INFINITY, symbols[0], symbols[-1]))
            while len(symbols) > 1:
                pairs = [(-self.scores[j], k) for k in range(len(symbols) - 1) if (j := self.ids.get(symbols[k] + symbols[k + 1])) is not None]
                if not pairs:
                    out = []
                    break
                cost, k = min(pairs)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                out.append((-cost, symbols[0], symbols[-1]))
            self.histories[i] = out
        return self.histories[i]

    def stay_apart(self, i: int, j: int) -> bool:
        """Whether merging the texts of two pieces together gives these two pieces.

        Both histories run side by side, the better merge first and the left one among equals. It fails as soon as
        the symbols that meet at the border would be the best merge.
        """
        left, right = self.history(i), self.history(j)
        if not left or not right:
            return False
        a = b = 0
        while True:
            across = self.ids.get(left[a][2] + right[b][1])
            next_left = left[a + 1][0] if a + 1 < len(left) else -INFINITY
            next_right = right[b + 1][0] if b + 1 < len(right) else -INFINITY
            if across is not None and self.scores[across] > next_left and self.scores[across] >= next_right:
                return False
            if next_left == next_right == -INFINITY:
                return True
            if next_left >= next_right:
                a += 1
            else:
                b += 1

    def join_cost(self, last: int, piece: int) -> float:
        """Weight of the step from one piece to the next; -1 stands for the start and for byte fallback, which nothing merges with."""
        if not self.merges:
            return 0.0
        if last < 0:
            return 0.0 if self.history(piece) else INFINITY
        return 0.0 if self.stay_apart(last, piece) else INFINITY

    def shortest_path(self, text: str) -> list[int]:
        """Ids of the best path through the lattice of a normalised text.

        One state a place is enough: a unigram model does not look at the last piece, and the merges of a beginning of
        the text are unique, so that only one last piece has a finite cost there and the first found is the best.
        """
        n = len(text)
        cost, last, before = [0.0] + [INFINITY] * n, [-1] * (n + 1), [0] * (n + 1)
        joins, arcs, ending, weight, merges = self.joins, self.arcs, self.ending, self.weights, self.merges
        if len(joins) > 200_000:
            joins.clear()
        state = 0
        for end, c in enumerate(text, 1):
            state = arcs[state].get(c) or self._next(state, c)
            best = INFINITY
            for piece, length in ending[state]:
                at = end - length
                total = cost[at] + weight[piece] + joins[last[at] << 20 | piece]
                if total < best:
                    best, last[end], before[end] = total, piece, at
                    if merges:
                        break
            if c not in self.ids and cost[end - 1] + self.fallback_weight < best:
                best, last[end], before[end] = cost[end - 1] + self.fallback_weight, -1, end - 1
            cost[end] = best
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())] if self.bytes else [self.unknown]
            at = before[at]
        return out[::-1]

    def _part_ids(self, part: str) -> bytes:
        return np.array(self.shortest_path(part), self.dtype).tobytes()

    def _word_ids(self, word: str) -> bytes:
        """A word's ids; it is cut between neighbours that no piece holds together."""
        pairs, known = self.pairs, self.known_parts
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        if not cuts:
            return self._part_ids(word)
        return b"".join([known[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])

    def _words(self, text: str) -> list[str]:
        """The normalised text, cut where no piece reaches across."""
        whole = (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)
        if SPACE + SPACE not in whole:
            return whole.replace("\n", " \n ").replace(SPACE, " " + SPACE).split(" ")
        return re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", whole)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian numbers of ``dtype``."""
        return [b"".join(map(self.known.__getitem__, self._words(text))) for text in texts]


@functools.lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@functools.lru_cache(maxsize=1)
def model_of(path: str) -> Model:
    return Model(path)


FORGET += [transducer.cache_clear, model_of.cache_clear]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (packed, ``id_bytes`` each) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = transducer(model)
        for batch in batches:
            for part in chunks(batch):
                ids = run.encode([t or "" for t in part.column("text").to_pylist()])
                width = pa.array(np.full(len(ids), run.dtype.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), width], ["doc_id", "ids", "id_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, ids binary, id_bytes int")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """Add the decoded text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = model_of(model)
        for batch in batches:
            ids = zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True)
            texts = [run.decode(np.frombuffer(x, f"<u{w}").tolist()) for x, w in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(rows, "doc_id long, ids binary, id_bytes int, text string")


def piece_digest(decoded: DataFrame) -> DataFrame:
    """n_pieces, unsigned crc32 of the ids as little-endian unsigned 32-bit numbers, SHA-256 of the decoded text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True)]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), batch.column("text")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "text"])

    digest = decoded.mapInArrow(rows, "doc_id long, n_pieces long, ids_crc32 long, text string")
    return digest.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
