"""Numpy steps over many texts at once: words, word shingles, and byte anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every run of ``width`` words, in order.

    Words are runs of bytes other than white space, with A-Z in lower case. A text of fewer words has its whole
    sequence as one shingle; a text without words has none. The hashes stand for the shingles.
    """
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    space = SPACE[buffer]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = BYTE_VALUES[LOWER[buffer]]
    values[space] = 0
    values = values[starts[0] :]
    lengths = np.diff(np.append(starts, len(buffer)))
    places = np.arange(starts[0], len(buffer)) - np.repeat(starts, lengths)
    values *= powers(BASE, int(lengths.max()))[places]
    words = mixed(np.add.reduceat(values, starts - starts[0]))
    owner = np.searchsorted(firsts, starts, "right") - 1
    n = len(words)
    sums = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        sums += words[k : n - width + 1 + k] * PLACES[k]
    whole = owner[: len(sums)] == owner[width - 1 :] if len(sums) else np.zeros(0, bool)
    owners, hashes = owner[: len(sums)][whole], mixed(sums[whole])
    counts = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.searchsorted(owner, short)
        extra = np.array([(words[a : a + c] * PLACES[:c]).sum(dtype=np.uint64) + np.uint64(c) for a, c in zip(at, counts[short], strict=True)], np.uint64)
        order = np.argsort(np.concatenate([owners, short]), kind="stable")
        owners, hashes = np.concatenate([owners, short])[order], np.concatenate([hashes, mixed(extra)])[order]
    return owners, hashes


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    owners, hashes = shingles(texts, width)
    cuts = np.searchsorted(owners, np.arange(1, len(texts)))
    return [np.unique(x) for x in np.split(hashes, cuts)]


#: Bytes of a match, of the strings that anchors are chosen by, and positions a packed anchor can tell apart.
MATCH, GRAM, PLACE_BITS = 100, 32, 19
WINDOW = MATCH - GRAM + 1
LONGEST = (1 << PLACE_BITS) - 1
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLES: list[np.ndarray] = []


def anchor_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first, count, key, digest) of every anchor, in parts.

    The anchor of a window of ``MATCH`` bytes is the string of ``GRAM`` bytes in it with the smallest hash, the
    leftmost of equal ones. It depends on the window's bytes alone, so equal windows have equal keys. Consecutive
    windows that share an anchor make one run: windows first, first + 1, ... (count of them, at most ``WINDOW``).
    The digest hashes all bytes of the run. Smallest hashes are not spread evenly, so keys are hashed once more.
    """
    if not _TABLES:
        _TABLES.extend([powers(BASE, LONGEST + 1), powers(INVERSE, LONGEST + 1)])
    pieces = [(i, a, t[a : a + LONGEST]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - MATCH + 1), LONGEST - MATCH + 1) if len(t) >= MATCH]
    held: list[tuple[int, int, bytes]] = []
    for piece in [*pieces, None]:
        if held and (piece is None or sum(len(x[2]) for x in held) + len(piece[2]) > LONGEST):
            yield _runs(held)
            held = []
        if piece:
            held.append(piece)


def _runs(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    forth, back = _TABLES
    buffer = np.frombuffer(b"".join(x[2] for x in pieces), np.uint8)
    sizes = np.array([len(x[2]) for x in pieces])
    starts = np.cumsum(sizes) - sizes
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * forth[: len(buffer)], out=sums[1:])
    n = len(buffer) - GRAM + 1
    grams = mixed((sums[GRAM:] - sums[:n]) * back[:n])
    low = np.uint64(LONGEST)
    packed = np.full(-(-n // WINDOW) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = (grams & ~low) | np.arange(n, dtype=np.uint64)
    blocks = packed.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WINDOW + 1
    anchor = (np.minimum(behind[:windows], ahead[WINDOW - 1 : WINDOW - 1 + windows]) & low).astype(np.int64)
    inside = np.zeros(windows + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes - MATCH + 1, -1)
    inside = np.cumsum(inside[:windows]) > 0
    edge = np.empty(windows, bool)
    edge[0] = True
    edge[1:] = anchor[1:] != anchor[:-1]
    edge[starts] = True
    heads = np.flatnonzero(edge & inside)
    breaks = np.append(np.flatnonzero(edge | ~inside), windows)
    counts = breaks[np.searchsorted(breaks, heads, "right")] - heads
    piece = np.searchsorted(starts, heads, "right") - 1
    number, offset = np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces])
    digest = mixed((sums[heads + counts + MATCH - 1] - sums[heads]) * back[heads] + counts.astype(np.uint64))
    return number[piece], heads - starts[piece] + offset[piece], counts, mixed(grams[anchor[heads]] ^ BASE), digest
