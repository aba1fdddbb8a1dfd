"""Ranks, prefixes and picks against brute force."""

import hashlib
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from mirrorset.operators import labels, order, runcontrol, sampling


def md5(seed, row_id):
    return hashlib.md5(f"{seed}:{row_id}".encode()).hexdigest()


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows = [(str(i), "hot" if rng.random() < 0.7 else rng.choice("abc"), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, label string, ord bigint")


def brute_rank(rows, seed):
    by_label = {}
    for row_id, label, _ in rows:
        by_label.setdefault(label, []).append(row_id)
    return {
        (label, row_id): place
        for label, ids in by_label.items()
        for place, row_id in enumerate(sorted(ids, key=lambda x: (md5(seed, x), x)), 1)
    }


def test_shuffled_rank_is_exact_under_skew(spark):
    rows, df = skewed(spark)
    want = brute_rank(rows, 42)
    got = order.shuffled_rank(df, 42, "id", ["label"]).collect()
    assert {(r["label"], r["id"]): r["rn"] for r in got} == want
    limited = order.shuffled_rank(df, 42, "id", ["label"], limit=50).collect()
    assert {(r["label"], r["id"]): r["rn"] for r in limited} == {k: v for k, v in want.items() if v <= 50}


def test_shuffle_does_not_depend_on_partitions(spark):
    _, df = skewed(spark)
    one = sorted(map(tuple, sampling.seeded_shuffle(df.coalesce(1), 7).collect()))
    many = sorted(map(tuple, sampling.seeded_shuffle(df.repartition(13), 7).collect()))
    assert one == many
    assert sorted(r[-1] for r in one) == list(range(1, len(one) + 1))


def test_batches_hold_at_most_their_size(spark):
    rows, df = skewed(spark)
    df = df.withColumn("text", F.col("id"))
    batches = sampling.collect_batches(
        sampling.assign_batches(sampling.sample_per_label(df, None, 42), 20)
    ).collect()
    want = brute_rank(rows, 42)
    seen = {}
    for b in batches:
        assert len(b["rows"]) <= 20
        for i, r in enumerate(b["rows"]):
            assert r["pos"] == i
            seen[(b["label"], r["id"])] = b["batch_no"] * 20 + i + 1
    assert seen == want


def test_earlier_sum_and_max_per_key(spark):
    rng = random.Random(3)
    rows = [(k, o, rng.randint(0, 9)) for k in "xy" for o in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, ord bigint, v bigint")
    for inclusive in (False, True):
        got = order.earlier(
            df, "ord", {"s": ("sum", F.col("v")), "m": ("max", F.when(F.col("v") > 7, F.col("ord")))},
            ["k"], bucket_rows=16, inclusive=inclusive,
        ).collect()
        for r in got:
            before = [x for x in rows if x[0] == r["k"] and (x[1] < r["ord"] or inclusive and x[1] == r["ord"])]
            assert r["s"] == (sum(x[2] for x in before) if before else None)
            assert r["m"] == max((x[1] for x in before if x[2] > 7), default=None)


def test_dense_order(spark):
    rng = random.Random(9)
    rows = [(o, k) for o in rng.sample(range(10_000), 120) for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "ord bigint, k int").repartition(5)
    got = sorted(map(tuple, order.dense_order(df, "ord", ["k"], bucket_rows=100).collect()))
    assert got == [(o, k, i) for i, (o, k) in enumerate(sorted(rows))]


def test_budget_keeps_the_crossing_example(spark):
    calls = spark.createDataFrame(
        [(0, 3), (0, 3), (1, 4), (2, 1), (3, 1)], "ord bigint, tokens bigint"
    )
    kept = runcontrol.within_budget(calls, limit=10, bucket_rows=2).collect()
    assert sorted((r["ord"], r["tokens"], r["spent"]) for r in kept) == [(0, 6, 0), (1, 4, 6), (2, 1, 10)]


def test_budget_grows_with_the_limit(spark):
    calls = spark.createDataFrame([(i, i % 7) for i in range(300)], "ord bigint, tokens bigint")
    sizes = [runcontrol.within_budget(calls, limit=n, bucket_rows=32).count() for n in (0, 50, 400, 10_000)]
    assert sizes == sorted(sizes) and sizes[-1] == 300


def results(spark, errors):
    return spark.createDataFrame(
        [(i, e) for i, e in enumerate(errors)], "ord bigint, error string"
    )


def brute_cut(errors, limit=5):
    kept, streak = [], 0
    for i, e in enumerate(errors):
        streak = streak + 1 if e else 0
        if e and ("429" in e or streak >= limit):
            break
        kept.append(i)
    return kept


def test_failure_cut(spark):
    rng = random.Random(11)
    cases = [
        [None, "f", "f", "f", "f", "f", None],
        ["f"] * 6,
        [None] * 4,
        [None, "f", "quota 429", None],
    ] + [[rng.choice([None, "f", "f"]) for _ in range(60)] for _ in range(3)]
    for errors in cases:
        got = runcontrol.stop_on_failures(results(spark, errors), bucket_rows=4).collect()
        assert sorted(r["ord"] for r in got) == brute_cut(errors)


def test_first_and_top_rows(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 2, "w")]
    df = spark.createDataFrame(rows, "id string, ord bigint, text string")
    assert sorted(map(tuple, sampling.first_per_id(df).select("id", "text").collect())) == [("a", "y"), ("b", "z")]
    top = sampling.topn_per_id(df, 2).select("id", "text", "sub").collect()
    assert sorted(map(tuple, top)) == [("a", "w", 2), ("a", "y", 1), ("b", "z", 1)]


def test_shot_prefixes_nest(spark):
    _, df = skewed(spark, 40)
    rows = sampling.shot_prefixes(df, (5, 10, 100), (1, 2)).collect()
    sets = {}
    for r in rows:
        sets.setdefault((r["seed"], r["shots"]), set()).add(r["id"])
    assert {k: len(s) for k, s in sets.items()} == {(1, 5): 5, (1, 10): 10, (2, 5): 5, (2, 10): 10}
    assert sets[(1, 5)] < sets[(1, 10)] and sets[(1, 10)] != sets[(2, 10)]
    assert sampling.shot_prefixes(df, (100,), (1,)).count() == 0


def test_fan_out_by_join_equals_fan_out_by_array(spark, monkeypatch):
    rows = [(str(i), 0, "ab"[i % 2], ["p", "q"][: i % 3], i) for i in range(30)]
    patterns = spark.createDataFrame(
        rows, "id string, pair_no int, ori_label string, phrases array<string>, ord bigint"
    )
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, first_ord bigint")
    columns = ["id", "phrase_no", "matched_phrase", "target_label", "target_no"]
    inline = sorted(map(tuple, labels.fan_out_targets(patterns, names).select(columns).collect()))
    monkeypatch.setattr(labels, "INLINE_LABELS", 2)
    joined = sorted(map(tuple, labels.fan_out_targets(patterns, names).select(columns).collect()))
    assert inline == joined and len(inline) == sum(len(r[3]) for r in rows) * 2


def test_label_names_past_z(spark):
    df = spark.createDataFrame([(f"l{i:04d}",) for i in range(730)], "label string")
    got = [r["masked"] for r in labels.label_map(df).orderBy("label").collect()]
    assert got[:2] == ["concept A", "concept B"]
    assert got[25:28] == ["concept Z", "concept AA", "concept AB"]
    assert got[701:704] == ["concept ZZ", "concept AAA", "concept AAB"]
    assert len(set(got)) == 730


def test_large_lookup_is_not_broadcast(spark):
    df = spark.range(20)
    assert order.bounded_rows(df, 10) is None
    assert len(order.bounded_rows(df, 20)) == 20
    assert order.pinned(df, 10) is df


def test_long_contexts_meet_requests_by_salt(spark):
    from mirrorset.operators.requests import attach_context

    asked = spark.createDataFrame(
        [(f"r{i}", 42, n, f"q{i}") for i in range(50) for n in (5, 10)],
        "request_id string, seed int, shots int, query string",
    )
    contexts = spark.createDataFrame(
        [(42, n, [("system", f"s{n}")]) for n in (5, 10)],
        "seed int, shots int, messages array<struct<role:string,content:string>>",
    )

    def rows(**options):
        full = attach_context(asked, contexts, **options)
        return sorted((r["request_id"], r["shots"], [tuple(t) for t in r["messages"]]) for r in full.collect())

    sent, salted = rows(), rows(broadcast_chars=0)
    assert sent == salted and len(sent) == 100
    assert sent[0] == ("r0", 5, [("system", "s5"), ("user", "q0")])


def test_request_ids_keep_keys_apart(spark):
    from mirrorset.functions.messages import request_id

    row = spark.range(1).select(
        request_id("s", F.lit("a:1"), F.lit("b")).alias("x"),
        request_id("s", F.lit("a"), F.lit("1:b")).alias("y"),
        request_id("t", F.lit("a"), F.lit("1:b")).alias("z"),
    ).first()
    assert len({row["x"], row["y"], row["z"]}) == 3




def test_sparse_orders_have_even_ranges(spark):
    """Times, strings and pairs: the running sum is exact and no range holds much more than its share."""
    rng = random.Random(6)
    times = rng.sample(range(1_600_000_000_000_000, 1_600_000_000_000_400), 300) + rng.sample(range(10**15, 10**18), 700)
    rows = [(t, f"name {rng.random()}", rng.choice("ab"), rng.randint(0, 9)) for t in times]
    df = spark.createDataFrame(rows, "t long, name string, half string, v long").repartition(6)
    for columns in (["t"], ["name"], ["half", "name"]):
        places = [["t", "name", "half"].index(c) for c in columns]
        ordered = sorted(rows, key=lambda r: [r[p] for p in places])
        want, total = {}, 0
        for place, r in enumerate(ordered):
            want[r[0]] = (total or None if place else None, place)
            total += r[3]
        out = order.earlier(df, columns, {"s": ("sum", F.col("v"))}, bucket_rows=50)
        got = order.numbered(out, columns, "n", bucket_rows=50).collect()
        assert {r["t"]: r["n"] for r in got} == {t: n for t, (_, n) in want.items()}
        assert all((r["s"] or None) == want[r["t"]][0] for r in got)
        bounds = order.range_bounds(df, columns, 20)
        sizes = df.groupBy(order.range_of(df, columns, bounds).alias("b")).count().collect()
        assert len(sizes) == len(bounds) + 1 == 20 and max(r["count"] for r in sizes) < 150


def test_ranges_of_null_and_equal_values(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (1, "c"), (2, "a")], "x long, y string")
    got = order.numbered(df, ["x", "y"], "n", bucket_rows=1).collect()
    assert {(r["x"], r["y"]): r["n"] for r in got} == {(None, "a"): 0, (None, "b"): 1, (1, None): 2, (1, "c"): 3, (2, "a"): 4}
    assert order.numbered(df.limit(0), ["x"], "n").count() == 0


def test_many_labels_are_numbered_by_ranges(spark, monkeypatch):
    table = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("label"), F.col("id").alias("first_ord"))
    few = sorted(map(tuple, labels.label_map(table).collect()))
    monkeypatch.setattr(labels, "local_rows", lambda df: None)
    monkeypatch.setattr(labels, "numbered", lambda df, by, out: order.numbered(df, by, out, bucket_rows=100))
    many = labels.label_map(table)
    assert sorted(map(tuple, many.collect())) == few
    monkeypatch.setattr(labels, "INLINE_LABELS", 10)
    patterns = spark.createDataFrame([(1, 0, "a", ["x"])], "ord long, pair_no int, ori_label string, phrases array<string>")
    got = labels.fan_out_targets(patterns, table).select("target_no", "target_label").collect()
    assert [r["target_label"] for r in sorted(got)] == [r["label"] for r in table.orderBy("first_ord", "label").collect()]


def test_range_of_reads_columns_outside_of_its_lambdas(spark):
    """A column that only a lambda mentions was looked for on the wrong side of the join in ``earlier``."""
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    placed = df.select("label", order.range_of(df, ["label"], [Row(label="b")]).alias("at"))
    plan = placed._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert "label#" not in plan.split("lambdafunction(", 1)[1]
    assert sorted(map(tuple, placed.collect())) == [("a", 0), ("b", 1), ("c", 1)]


def test_beside_is_a_join(spark):
    """Like a join with equal nulls, also of repeated keys, and all rows of a group come out of one task."""
    rng = random.Random(4)
    wide = [(rng.choice([None, *range(6)]), rng.choice([None, "a", "b"]), i) for i in range(60)]
    narrow = [(rng.choice([None, *range(6)]), rng.choice([None, "a", "b"]), rng.choice([None, f"t{i}"]), i) for i in range(12)]
    left = spark.createDataFrame(wide, "g int, k string, n int").repartition(3)
    right = spark.createDataFrame(narrow, "g int, k string, text string, m int").repartition(2)
    for inner in (False, True):
        joined = order.beside(left, right, ["g", "k"], "g", inner)
        want = [(*w, *(x[2:])) for w in wide for x in narrow if w[:2] == x[:2]]
        want += [] if inner else [(*w, None, None) for w in wide if w[:2] not in {x[:2] for x in narrow}]
        assert joined.columns == ["g", "k", "n", "text", "m"]
        assert sorted(map(str, map(tuple, joined.collect()))) == sorted(map(str, want))
        parts = joined.select("g", F.spark_partition_id().alias("p")).distinct().groupBy("g").count()
        assert {r["count"] for r in parts.collect()} == {1}
