"""Macro scores, prefixes and summaries against plain Python."""

import random
import statistics

import pytest

from mirrorset.operators import evaluation


def frame(spark, rows):
    return spark.createDataFrame(rows, "seed int, shots int, ord bigint, y_true string, y_pred string")


def macro(pairs):
    classes = {c for p in pairs for c in p}
    scores = []
    for c in classes:
        tp = sum(t == p == c for t, p in pairs)
        truth, pred = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
        scores.append(
            (tp / pred if pred else 0, tp / truth if truth else 0, 2 * tp / (truth + pred) if tp else 0)
        )
    n = len(classes)
    return [sum(s[i] for s in scores) / n for i in range(3)] + [sum(t == p for t, p in pairs) / len(pairs)]


def test_hand_example(spark):
    pairs = list(zip("aabbc", "axbac"))
    rows = [(1, 10, i, t, p) for i, (t, p) in enumerate(pairs)]
    got = evaluation.macro_prf(frame(spark, rows)).first()
    assert got["precision"] == pytest.approx(0.625) and got["recall"] == pytest.approx(0.5)
    assert got["fscore"] == pytest.approx(macro(pairs)[2]) and got["accuracy"] == pytest.approx(0.6)
    assert got["test_size"] == 5


def test_prefixes_equal_scores_of_each_prefix(spark):
    rng = random.Random(4)
    rows = [
        (s, 10, o, rng.choice("abcd"), rng.choice("aabcdxy"))
        for s in (1, 2)
        for o in range(130)
        if rng.random() < 0.9
    ]
    got = evaluation.prefix_metrics(frame(spark, rows), 10, bucket_rows=3).collect()
    want = {(r[0], r[2] + 1) for r in rows if (r[2] + 1) % 10 == 0}
    assert {(r["seed"], r["checkpoint"]) for r in got} == want
    for r in got:
        pairs = [(x[3], x[4]) for x in rows if x[0] == r["seed"] and x[2] < r["checkpoint"]]
        assert [r["precision"], r["recall"], r["fscore"], r["accuracy"]] == pytest.approx(macro(pairs))
        assert r["test_size"] == len(pairs)


def test_seed_summary(spark):
    rows = [(s, n, s / 10, s / 20, s / 30, s / 40, 9) for s in (1, 2, 4) for n in (10, 15)]
    metrics = spark.createDataFrame(
        rows, "seed int, shots int, precision double, recall double, fscore double, accuracy double, test_size bigint"
    )
    final = evaluation.final_metrics(metrics)
    assert {r["shots"] for r in final.collect()} == {15}
    total = evaluation.seed_summary(final, []).first()
    values = [0.1, 0.2, 0.4]
    assert total["precision_mean"] == pytest.approx(statistics.fmean(values))
    assert total["precision_std"] == pytest.approx(statistics.pstdev(values))
    assert evaluation.seed_summary(metrics).count() == 2
    assert evaluation.final_metrics(metrics.filter("shots > 99")).count() == 0
