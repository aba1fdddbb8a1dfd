"""Suffix dedup, near duplicates and fingerprints against brute force."""

import random

import numpy as np
import pytest

from mirrorset.llm import graph, jaccard, sketches, suffixes
from mirrorset.llm.bytesets import anchor_runs, shingle_sets
from mirrorset.llm.staging import numbered

import brute
from samples import ODD


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def related(spark):
    """Copies, near copies, shared passages and runs of one letter, in documents of all lengths."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(160):
        text = [word() for _ in range(rng.choice([0, 2, 5, 30, 120, 400]))]
        if rng.random() < 0.5:
            text.insert(rng.randint(0, len(text)), rng.choice(passages))
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 3, 12])):
                text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    rows += [(160, "a" * 350), (161, "b" * 99), (162, "b" * 100), (163, "xy" * 90), (164, "a" * 120)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def spans_of(docs):
    return {r["doc_id"]: [(x["begin"], x["end"]) for x in r["__spans"]] for r in suffixes.mark_repeats(docs).collect()}


@pytest.mark.parametrize("hot, block, batches", [(4096, 400_000, 4), (1, 300, 3)])
def test_repeated_bytes(related, monkeypatch, hot, block, batches):
    rows, docs = related
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "BATCHES", batches)
    want = brute.repeated_spans([t.encode() for _, t in rows])
    assert spans_of(docs) == dict(enumerate(want))


def test_repeats_in_odd_documents(odd, none):
    got = suffixes.mark_repeats(odd).collect()
    assert len(got) == len(ODD)
    spans = {(r["doc_id"], r["text"]): [(x["begin"], x["end"]) for x in r["__spans"]] for r in got}
    n = len(ODD[0][1])
    assert spans[1, ODD[0][1]] == [] and spans[4, ODD[3][1]] == [(0, n)] and spans[7, ODD[7][1]] == [(0, n)]
    assert spans[2, None] == spans[3, ""] == []
    kept = {(r["doc_id"], r["text"]) for r in suffixes.without_repeats(odd).collect()}
    assert (4, "") in kept and (7, " with a tail") in kept and (2, None) in kept
    assert suffixes.without_repeats(odd).columns == odd.columns
    assert suffixes.without_repeats(none).count() == 0


def test_cut_texts_stay_whole_characters(spark):
    tail = "é" * 60
    docs = spark.createDataFrame([(1, "x" + tail), (2, "é" + tail + "ü")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(docs).collect()}
    # the last match ends inside the last character, which stays
    assert texts == {1: "xé", 2: "ü"}


def test_every_window_lies_in_one_run():
    text = bytes(random.Random(1).choices(b"ab ", k=5000)) + b"z" * 300
    windows = [s for _, first, count, _, _ in anchor_runs([b"short", text]) for a, n in zip(first, count, strict=True) for s in range(a, a + n)]
    assert sorted(windows) == list(range(len(text) - 99))


@pytest.mark.parametrize("small, frequent", [(8, 32), (2, 3)])
def test_near_duplicate_components(related, monkeypatch, small, frequent):
    rows, docs = related
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "CELL", 3)
    got = {r["__doc"]: (r["n_shingles"], r["__label"]) for r in jaccard.near_duplicates(numbered(docs)).collect()}
    texts = [t for _, t in rows]
    want = brute.components(texts)
    assert got == {i: (len(brute.shingle_set(t)), want[i]) for i, t in enumerate(texts)}


def test_odd_documents_keep_their_first(odd, none):
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in jaccard.keep_one(odd).collect())
    ids = [i for _, i in kept]
    assert 4 not in ids and 10 not in ids and {1, 2, 3, 6, 8, 9} <= set(ids) and ids.count(5) == 2
    assert jaccard.keep_one(odd).columns == odd.columns
    assert jaccard.keep_one(none).count() == 0


def test_words_of_linked_sets_always_meet():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 8, 15, 16, 40, 63, 64, 100, 127, 128, 500, 1100]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(20):
            common = rng.permutation(a)[: max(1, int(np.ceil(0.86 * n)))]
            b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, n // 6 + 1), dtype=np.uint64)]))
            hot = np.sort(rng.permutation(a)[: n // 3])
            if jaccard.links(len(a), len(b), len(np.intersect1d(a, b))):
                keys = [set(np.concatenate(jaccard.word_keys(x, hot)).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for n, m in ((10, 12), (100, 100), (700, 900)):
        a, b = (np.unique(rng.integers(0, 2000, k)).astype(np.uint64) for k in (n, m))
        assert jaccard.hamming(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 7)], "a long, b long")
    got = {r["doc"]: r["label"] for r in graph.components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_fingerprints_of_whole_and_edited_texts(odd, none, related):
    rows, docs = related
    got = {r["doc_id"]: r for r in sketches.with_edited(docs, 7).collect()}
    import hashlib

    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = brute.shingle_set(t), brute.shingle_set(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i]["near_edited"] - true) < (1e-9 if len(a | b) <= sketches.K else 0.2)
    assert sketches.with_edited(odd, 3).count() == len(ODD)
    same = [r["fingerprint"] for r in sketches.with_edited(odd, 3).collect() if r["doc_id"] in (1, 4)]
    assert same[0] == same[1]
    assert sketches.with_edited(none, 3).count() == 0


def test_fingerprints_merge(spark, related):
    rows, docs = related
    table = sketches.fingerprints(docs).selectExpr("doc_id % 3 AS key", "fingerprint")
    got = {r["key"]: r["fingerprint"] for r in sketches.merge_fingerprints(table, "key").collect()}
    for key in range(3):
        sets = shingle_sets([t.encode() for i, t in rows if i % 3 == key])
        whole = np.unique(np.concatenate(sets))
        assert got[key] == sketches.written(whole[: sketches.K])
        assert abs(sketches.distinct(sketches.read(got[key])) / len(whole) - 1) < 0.3
    a, b = np.arange(1000, dtype=np.uint64) << np.uint64(40), np.arange(500, dtype=np.uint64) << np.uint64(40)
    assert sketches.containment(b[:100], a[:120]) == 1.0
