"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into pieces of ``PIECE`` bytes that run through the network side by side. Each runs with the
``SIDE`` bytes before and after it, which are not scored there, so that every byte has context on both sides.
Two gated recurrent layers, one from each end, give every byte a state; an output layer
labels every byte with log probabilities of the languages, and a document's
probabilities are the softmax of their mean over all its bytes. The network is
trained in numpy by backpropagation through time, with Adam, on a bounded sample of labelled
documents: ``PER_LABEL`` documents of each language, the first by a hash of their id (of all but those whose hash is too
large to be among them, told from the number of ids), and
``SAMPLE_BYTES`` bytes from a hashed place of each.

Null texts and texts without a letter (``str.isalpha``) are ``und`` with score 0. Without labels to learn
from everything is ``und``. Repeated rows get the same label, an empty table gives an empty
result, other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .staging import chunks, tidy

UNKNOWN = "und"
#: Bounds of the training sample, and sizes of the network and its training.
PER_LABEL, SAMPLE_BYTES = 400, 256
HIDDEN, PIECE, SIDE, EPOCHS, BATCH, RATE = 8, 64, 16, 12, 128, 0.02


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """A hard sigmoid in place: a line between 0 and 1."""
    x *= 0.2
    x += 0.5
    return np.clip(x, 0.0, 1.0, out=x)


@dataclass
class Network:
    """Weights: for each direction three tables by byte (update, reset, new), three recurrent matrices, and biases of the output."""

    labels: list[str]
    inputs: np.ndarray  # 2 x 3 x 257 x hidden; byte 256 is padding
    turns: np.ndarray  # 2 x 3 x hidden x hidden
    outputs: np.ndarray  # 2 x hidden x labels
    bias: np.ndarray  # labels

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        scaled = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        return cls(labels, scaled(2, 3, 257, hidden), scaled(2, 3, hidden, hidden), scaled(2, hidden, len(labels)), np.zeros(len(labels), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.turns, self.outputs, self.bias]

    def run(self, pieces: np.ndarray, d: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each byte of one direction (pieces: steps x count, already in its order); what training needs."""
        steps, count = pieces.shape
        states = np.zeros((steps + 1, count, self.inputs.shape[-1]), np.float32)
        tape = []
        (x_update, x_reset, x_new), (h_update, h_reset, h_new) = self.inputs[d], self.turns[d]
        for t in range(steps):
            h, at = states[t], pieces[t]
            update, reset = h @ h_update, h @ h_reset
            update += x_update.take(at, axis=0)
            reset += x_reset.take(at, axis=0)
            inner = h @ h_new
            if keep:
                raw = update.copy(), reset.copy()
            _sigmoid(update)
            _sigmoid(reset)
            new = reset * inner
            new += x_new.take(at, axis=0)
            np.tanh(new, out=new)
            if keep:
                tape.append((raw, update, reset, inner, new))
            # h + update * (new - h)
            step = states[t + 1]
            np.subtract(new, h, out=step)
            step *= update
            step += h
        return states, tape

    def log_probabilities(self, pieces: np.ndarray) -> np.ndarray:
        """steps x count x labels: the label of every byte."""
        forth = self.run(pieces, 0)[0][1:]
        back = self.run(pieces[::-1], 1)[0][1:][::-1]
        scores = forth @ self.outputs[0]
        scores += back @ self.outputs[1]
        scores += self.bias
        scores -= scores.max(axis=-1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=-1, keepdims=True))
        return scores

    def gradients(self, pieces: np.ndarray, real: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the real bytes, and its gradients, by backpropagation through time."""
        steps, count = pieces.shape
        runs = [self.run(pieces, 0, True), self.run(pieces[::-1], 1, True)]
        hidden = [runs[0][0][1:], runs[1][0][1:][::-1]]
        scores = hidden[0] @ self.outputs[0] + hidden[1] @ self.outputs[1] + self.bias
        scores -= scores.max(axis=-1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=-1, keepdims=True)
        n = max(1, int(real.sum()))
        loss = float(-(np.log(np.maximum(np.take_along_axis(p, np.broadcast_to(wanted, (steps, count))[..., None], -1)[..., 0], 1e-9)) * real).sum() / n)
        d_scores = p
        np.put_along_axis(d_scores, np.broadcast_to(wanted, (steps, count))[..., None], np.take_along_axis(p, np.broadcast_to(wanted, (steps, count))[..., None], -1) - 1, -1)
        d_scores *= (real / n)[..., None]
        g_in, g_turn, g_out = np.zeros_like(self.inputs), np.zeros_like(self.turns), np.zeros_like(self.outputs)
        g_bias = d_scores.sum(axis=(0, 1))
        for d in (0, 1):
            states, tape = runs[d]
            own = pieces if d == 0 else pieces[::-1]
            scored = d_scores if d == 0 else d_scores[::-1]
            g_out[d] = np.tensordot(states[1:], scored, ([0, 1], [0, 1]))
            h_update, h_reset, h_new = self.turns[d]
            carried = np.zeros_like(states[0])
            for t in range(steps - 1, -1, -1):
                (raw_update, raw_reset), update, reset, inner, new = tape[t]
                h = states[t]
                carried = carried + scored[t] @ self.outputs[d].T
                d_new = carried * update * (1 - new * new)
                d_update = carried * (new - h) * 0.2 * (np.abs(raw_update) < 2.5)
                d_reset = d_new * inner * 0.2 * (np.abs(raw_reset) < 2.5)
                d_inner = d_new * reset
                for k, (x, y) in enumerate(((d_update, d_update), (d_reset, d_reset), (d_new, d_inner))):
                    np.add.at(g_in[d, k], own[t], x)
                    g_turn[d, k] += h.T @ y
                carried = carried * (1 - update) + d_update @ h_update.T + d_reset @ h_reset.T + d_inner @ h_new.T
        return loss, [g_in, g_turn, g_out, g_bias]


def pieces_of(texts: list[bytes], size: int = PIECE, side: int = SIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts as columns of ``side + size + side`` steps (256 pads), which of them are scored, and each column's text.

    Every byte is scored once: the ``side`` steps at both ends are the neighbours' bytes.
    """
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.full((len(owner), size + 2 * side), 256, np.int16)
    at = 0
    for t, c in zip(texts, counts.tolist(), strict=True):
        if c:
            line = np.full(c * size + 2 * side, 256, np.int16)
            line[side : side + len(t)] = np.frombuffer(t, np.uint8)
            out[at : at + c] = np.lib.stride_tricks.sliding_window_view(line, size + 2 * side)[::size]
            at += c
    scored = out < 256
    scored[:, :side] = scored[:, size + side :] = False
    return np.ascontiguousarray(out.T), np.ascontiguousarray(scored.T), owner


def train(rows: list[tuple[bytes, str]], seed: int = 0) -> Network:
    """A network for (text, label) rows."""
    labels = sorted({label for _, label in rows})
    net = Network.fresh(labels, seed=seed)
    pieces, scored, owner = pieces_of([t for t, _ in rows])
    wanted = np.array([labels.index(label) for _, label in rows], np.int64)[owner]
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step = 0
    total = EPOCHS * -(-len(owner) // BATCH)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(owner)), max(1, -(-len(owner) // BATCH))):
            _, gradients = net.gradients(pieces[:, part], scored[:, part].astype(np.float32), wanted[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            step += 1
            for w, g, m, v in zip(net.weights(), gradients, first, second, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (RATE * (1 - step / (total + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def predict(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the label and its probability for each text."""
    pieces, scored, owner = pieces_of(texts)
    sums = np.zeros((len(texts), len(net.labels)))
    for a in range(0, pieces.shape[1], 4096):
        own = np.ascontiguousarray(pieces[:, a : a + 4096])
        logs = net.log_probabilities(own)
        logs[~scored[:, a : a + 4096]] = 0.0
        np.add.at(sums, owner[a : a + 4096], logs.sum(axis=0))
    means = sums / np.maximum(1, [len(t) for t in texts])[:, None]
    p = np.exp(means - means.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return best, p[np.arange(len(texts)), best]


def training_rows(docs: DataFrame, may_train: Column) -> list[tuple[bytes, str]]:
    """The training sample: bounded by ``PER_LABEL`` rows a label and ``SAMPLE_BYTES`` bytes a row."""
    text = F.col("text").cast("string")
    usable = docs.where(may_train & F.col("lang").isNotNull() & text.rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length(text) - SAMPLE_BYTES)) + 1
    cut = usable.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.substring(text, place.cast("int"), F.lit(SAMPLE_BYTES)).alias("cut"))
    # about eight times the rows wanted have a hash below the bound of their language, so few meet in its task
    ids = usable.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.approx_count_distinct("doc_id").alias("n"))
    bound = (F.lit(8.0 * PER_LABEL) / F.col("n") - 0.5) * F.lit(2.0**64)
    cut = cut.join(F.broadcast(ids.select("lang", F.least(bound, F.lit(2.0**63)).alias("most"))), "lang").where(F.col("h") <= F.col("most"))
    order = Window.partitionBy("lang").orderBy("h", "cut")
    picked = cut.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_LABEL)
    return [(r["cut"].encode()[:SAMPLE_BYTES], r["lang"]) for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["place"]))]


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, text):
                texts = [t or "" for t in piece.column(text).to_pylist()]
                fine = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
                label, score = np.full(len(texts), -1), np.zeros(len(texts))
                if fine:
                    label[fine], score[fine] = predict(net, [texts[i].encode() for i in fine])
                names = [net.labels[k] if k >= 0 else UNKNOWN for k in label]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(names, pa.string()), pa.array(score)], [*piece.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(rows, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: the crc32 of its id leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained_on(docs: DataFrame) -> Network | None:
    """A network for the labels of the documents that are not held out; None without any."""
    rows = training_rows(docs, ~held_out())
    return train(rows) if rows else None
