"""Token store, packing and pieces against the tokenizer libraries."""

import itertools
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mirrorset.llm import encoding, idstore, packing, staging, transducer
from mirrorset.llm.encoding import WordEncoder
from mirrorset.llm.staging import new_path

from samples import ODD

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = st.lists(st.sampled_from(["a", "The", "ing", "É", "Σ", "́", " ", "  ", "\n", "\t", "\x1c", " ", "'s", "12", ".", ",!", "日本", "👍", "▁", "==", "\x00"]), max_size=14).map("".join)


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def tools():
    byte, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    return [(WordEncoder(BYTES, "lead", kept=50), byte), (WordEncoder(WORDS, "drop", kept=50), word)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_cut_words_encode_like_whole_texts(tools, texts):
    for ours, library in tools:
        want = [np.array(e.ids, ours.dtype).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert ours.encode(texts) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=200), st.integers(0, 5000))
def test_elias_fano_gives_its_values_back(steps, extra):
    values = np.cumsum([0, *steps])
    ef = idstore.EliasFano.of(values, int(values[-1]) + extra)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_store_gives_ids_in_order_of_documents(spark, odd):
    tool = Tokenizer.from_file(BYTES)
    path = new_path(spark, "test-store")
    idstore.write_store(odd, path, BYTES, 2, segment_ids=50)
    store = idstore.open_store(spark, path)
    got = idstore.id_digest(idstore.read_documents(store, at_once=3)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    want = sorted((i or -1, len(x := tool.encode(t or "", add_special_tokens=False).ids + [2]), crc(x)) for i, t in ODD)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    first = store.selectExpr("shard", "segment", "n_docs - 1 AS place")
    ends = {r["start"]: r["doc_id"] for r in idstore.read_at(store, first).collect()}
    assert ends.items() <= {r["start"]: r["doc_id"] for r in got}.items()


def test_stored_digest_reads_in_one_step(spark, odd):
    path = new_path(spark, "test-store")
    idstore.write_store(odd, path, BYTES, 2, segment_ids=50)
    store = idstore.open_store(spark, path)
    one = idstore.stored_digest(store, at_once=3)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, idstore.id_digest(idstore.read_documents(store)).collect()), key=str)


def test_lean_packing_leaves_workers_without_words(spark, odd, monkeypatch):
    freed = []
    monkeypatch.setattr(packing, "tidy", lambda rows: freed.append(rows) or staging.tidy(rows))
    plain = packing.pack_documents(odd, WORDS, 1, capacity=64, group=4)
    assert not freed
    lean = packing.pack_documents(odd, WORDS, 1, capacity=64, group=4, lean=True)
    assert len(freed) == 1 and "Scan parquet" in lean._jdf.queryExecution().executedPlan().toString()
    columns = ["doc_id", "piece", "start", "length", "ids"]
    assert sorted(map(str, lean.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    assert encoding.encoder(WORDS, "drop", packing.LEAN_BYTES).words.kept == packing.LEAN_BYTES // 2
    staging.release_memory()
    assert encoding.encoder.cache_info().currsize == 0


def test_empty_tables(spark, none):
    path = new_path(spark, "test-store")
    idstore.write_store(none, path, BYTES, 2)
    assert idstore.read_documents(idstore.open_store(spark, path)).count() == 0
    assert packing.pack_documents(none, WORDS, 1).count() == 0
    assert transducer.encode_pieces(none, PIECES).count() == 0


def test_packing_keeps_every_piece(spark, odd):
    tool = Tokenizer.from_file(WORDS)
    got = packing.piece_digest(packing.pack_documents(odd, WORDS, 1, capacity=64, group=4)).collect()
    want = []
    for i, t in ODD:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i or -1, k, a, len(ids[a : a + 64]), crc(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        items.sort()
        assert [a for a, _ in items] == [0, *np.cumsum([n for _, n in items])[:-1].tolist()]
        assert sum(n for _, n in items) <= 64


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_local_search_never_loses_items(sizes):
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    plain = packing.Bins(sizes, 100)
    plain.best_fit()
    assert len(bins) <= len(plain.packed())


def test_local_search_empties_a_bin():
    bins = packing.Bins([6, 4, 5, 5, 5, 5], 10)
    bins.items, bins.fill = [[0], [1, 2], [3, 4], [5]], [6, 9, 10, 5]
    bins.improve()
    assert len(bins.packed()) == math.ceil(30 / 10)


def test_local_search_goes_on_until_nothing_changes():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.choice((1, 2, 3, 5, 7, 11, 13)) for _ in range(60)] + [rng.randrange(20, 70) for _ in range(20)]
        bins = packing.Bins(sizes, 100)
        order = rng.sample(range(len(sizes)), len(sizes))
        for i in order:  # next fit, a poor start
            if not bins.fill or bins.fill[-1] + sizes[i] > 100:
                bins.items.append([])
                bins.fill.append(0)
            bins.items[-1].append(i)
            bins.fill[-1] += sizes[i]
        bins.improve()
        packed = bins.packed()
        assert sorted(i for b in packed for i in b) == list(range(len(sizes)))
        assert bins.fill == [sum(sizes[i] for i in b) for b in bins.items] and max(bins.fill) <= 100
        if len(packed) == -(-sum(sizes) // 100):
            continue
        for a in packed:
            for b in packed:
                have, other = sum(sizes[i] for i in a), sum(sizes[i] for i in b)
                if a is b or other < have or other == 100:
                    continue
                one, back = [sizes[i] for i in a], [sizes[i] for i in b]
                two, two_back = [x + y for x, y in itertools.combinations(one, 2)], [x + y for x, y in itertools.combinations(back, 2)]
                gains = [g - t for g in one for t in [0, *back, *two_back]] + [g - t for g in two for t in [0, *back]]
                assert not any(0 < g <= 100 - other for g in gains)


@pytest.fixture(scope="module")
def pieces():
    return transducer.Transducer(PIECES, kept=50), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_best_paths_are_the_library_s_encoding(pieces, texts):
    ours, library = pieces
    ids = [np.frombuffer(x, ours.dtype).tolist() for x in ours.encode(texts)]
    assert ids == library.encode(texts)
    assert [ours.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_pieces_of_odd_documents_decode_to_their_texts(spark, odd):
    got = transducer.decode_pieces(transducer.encode_pieces(odd, PIECES), PIECES).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted((i or -1, t or "") for i, t in ODD)


def test_unigram_weights_take_the_cheapest_path():
    tool = transducer.Transducer(PIECES)
    tool.merges = False
    tool.joins.clear()
    tool.weights = [1.0 if p in ("▁", "a", "b") else 1.5 if p == "ab" else 99.0 for p in tool.pieces]
    assert [tool.pieces[i] for i in tool.shortest_path("▁ab")] == ["▁", "ab"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(20, 100), min_size=1, max_size=9))
def test_fewest_bins_is_a_lower_bound(sizes):
    def fits(rest, rooms):
        return not rest or any(r >= rest[0] and fits(rest[1:], [*rooms[:k], r - rest[0], *rooms[k + 1 :]]) for k, r in enumerate(rooms) if r not in rooms[:k])

    best = next(n for n in range(1, len(sizes) + 1) if fits(sorted(sizes, reverse=True), [100] * n))
    assert packing.fewest(sizes, 100) <= best


def test_equal_sizes_take_no_long_search():
    for size, each in ((1366, 2), (1000, 4), (2049, 1)):
        start = time.process_time()
        assert len(packing.pack([size] * 8192, 4096)) == -(-8192 // each)
        assert time.process_time() - start < 10


def test_remembered_words_keep_to_their_bytes():
    tool = WordEncoder(WORDS, "drop", kept=100_000)
    run = transducer.Transducer(PIECES, kept=100_000)
    texts = [f"w{'abcdefghij'[i % 10]}{i:x}o, x" for i in range(5000)]
    tool.encode(texts)
    run.encode(texts)
    assert tool.words.held <= 51_000 and len(tool.words.older) * 200 <= 51_000
    assert run.known.held <= 51_000 and run.known_parts.held <= 51_000


def test_remembered_words_take_little_memory():
    """Words that a worker remembers, counted as Python holds them: several workers share an executor's memory."""
    from mirrorset.llm import encoding, transducer

    kept = transducer._Known(lambda word: bytes(6), transducer.KEPT_BYTES)
    tracemalloc.start()
    for i in range(800_000):
        kept[f"word{i:08}"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert encoding.KEPT_BYTES <= 96 << 20


def test_plain_texts_and_words_skip_the_patterns(monkeypatch):
    """Texts of words parted by single spaces and line ends are encoded without a search, and as the library does."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from mirrorset.llm import encoding

    class Unused:
        def search(self, text):
            raise AssertionError(text)

        fullmatch = search

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, run = Tokenizer.from_file(path), encoding.WordEncoder(path, "lead")

    def same(texts):
        got = [np.frombuffer(x, run.dtype).tolist() for x in run.encode(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    same(["", "a\nb", "a  b", " a", "a ", "a\tb", "a\xa0b", "\x1ca", "a\n\nb", "a \nb", "über, Straße", "don't x1", "a\r\nb"])
    monkeypatch.setattr(encoding, "SPACES_MEET", Unused())
    monkeypatch.setattr(encoding, "LATIN_WORD", Unused())
    same(["", "Some plain\nwords stand HERE", "alone"])


def test_more_words_than_are_remembered():
    """Words that come round again are not all merged again, and other words take over when texts change."""
    from tokenizers import Tokenizer

    from mirrorset.llm import encoding

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, tool = Tokenizer.from_file(path), encoding.WordEncoder(path, "drop", kept=60_000)
    merged, letters = [], tool.words.letters
    tool.words.letters = lambda word: merged.append(word) or letters(word)

    def texts(first):
        return [f"{first}{a}{b} {first}{b}{a}, x" for a in "abcdefghij" for b in "klmnopqrst"]

    for _ in range(4):
        tool.encode(texts("w"))
    assert len(merged) < 4 * 200 * 0.8
    for _ in range(4 * encoding.ROUNDS):
        got = [np.frombuffer(x, tool.dtype).tolist() for x in tool.encode(texts("v"))]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts("v")]
    assert "wak" not in tool.words and any(w.startswith("v") for w in tool.words)
    assert tool.words.held <= 31_000 and len(tool.words) * 200 <= 31_000 and len(tool.words.older) * 200 <= 31_000
