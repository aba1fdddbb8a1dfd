"""Second runs in one folder: changed inputs, stops, repeated ids, empty replies."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mirrorset.operators import evaluation, labels, model, runcontrol
from mirrorset.plans import augmentation, scoring
from mirrorset.plans import run as run_module
from mirrorset.plans.run import Run, client_responder
from mirrorset.sources import folders, stages

from test_plans import TEXTS, talking_client

SCHEMA = "id string, text string, label string, ord bigint"


def plain_client(*failing):
    """Answers every generation request, except those with a word in ``failing``."""

    def make():
        def client(messages, **_):
            if any(word in messages[-1]["content"] for word in failing):
                raise RuntimeError("timeout")
            return "fine"

        return client

    return make


def test_changed_texts_are_asked_again(spark, tmp_path):
    run = Run(spark, str(tmp_path), "m", "d", client_responder(talking_client(), 2))
    first = augmentation.augment(run, spark.createDataFrame(TEXTS, SCHEMA)).count()
    changed = [(i, text.replace("the ", "a "), label, o) for i, text, label, o in TEXTS]
    fresh = Run(spark, str(tmp_path / "fresh"), "m", "d", run.respond)
    table = spark.createDataFrame(changed, SCHEMA)
    want = sorted(map(tuple, augmentation.augment(fresh, table).collect()))
    assert sorted(map(tuple, augmentation.augment(run, table).collect())) == want
    assert len(want) == first and any("a soup" in row[1] for row in want)


def test_changed_context_is_asked_again(spark, tmp_path):
    def counting():
        def client(messages, **_):
            return f"concept {len(messages)}"

        return client

    make = Run(spark, str(tmp_path), "m", "d", client_responder(talking_client(), 2))
    augmentation.augment(make, spark.createDataFrame(TEXTS, SCHEMA))
    filtered = make.load("filtered")
    run = Run(spark, str(tmp_path / "s"), "m", "d", client_responder(counting))
    test = spark.createDataFrame([("a", "xx", "food", 0), ("b", "y", "price", 1)], SCHEMA)

    def said(most):
        scoring.score(run, filtered, test, shots=(2, 3), max_counterfactuals=most)
        return {(r["shots"], r["y_pred"]) for r in run.load("predictions").collect()}

    def sizes():
        return {(r["shots"], f"concept {len(r['messages']) + 1}") for r in run.load("contexts").collect()}

    assert said(4) == sizes()
    assert said(0) == sizes() == {(2, "concept 6"), (3, "concept 8")}


def test_long_contexts_are_joined(spark, monkeypatch):
    contexts = spark.createDataFrame(
        [(1, 2, [("system", "s"), ("user", "u")])], "seed int, shots int, messages array<struct<role:string,content:string>>"
    )
    asked = spark.createDataFrame([("r", 1, 2, "q")], "request_id string, seed int, shots int, query string")

    def make():
        return lambda messages: "|".join(m["content"] for m in messages)

    got = [model.apply_model(asked, make, contexts=contexts).first()["text"]]
    monkeypatch.setattr(model, "BROADCAST_CHARS", 0)
    got.append(model.apply_model(asked, make, contexts=contexts).first()["text"])
    assert got == ["s|u|q", "s|u|q"]


@pytest.fixture(scope="module")
def candidates(spark, tmp_path_factory):
    rows = [(i, i // 2, 0, 0, f"id{i // 2}", f"text {i}", "a", f"t{i % 2}", i % 2, ["x"], "p", "m") for i in range(40)]
    schema = (
        "n int, ord bigint, pair_no int, phrase_no int, id string, ori_text string, ori_label string, "
        "target_label string, target_no int, candidate_phrases array<string>, pattern string, matched_phrase string"
    )
    return spark.createDataFrame(rows, schema).drop("n")


def test_a_stopped_stage_goes_on(spark, tmp_path, candidates):
    ill = Run(spark, str(tmp_path), "m", "d", client_responder(plain_client("text 21", "text 22", "text 23", "text 24")))
    made = augmentation.generate(ill, candidates, max_consecutive=3)
    rows = {r["ori_text"]: r["counterfactual"] for r in made.collect()}
    assert rows == {f"text {i}": "" if i in (21, 22) else "fine" for i in range(23)}
    assert ill.store("generation").log_rows().count() == 23
    well = Run(spark, str(tmp_path), "m", "d", client_responder(plain_client()), attempt=1)
    rows = {r["ori_text"]: r["counterfactual"] for r in augmentation.generate(well, candidates, 3).collect()}
    assert rows == {f"text {i}": "" if i in (21, 22) else "fine" for i in range(40)}
    rows = augmentation.generate(well, candidates, 3, retry_failed=True).collect()
    assert Counter(r["counterfactual"] for r in rows) == {"fine": 40}


def test_calls_past_a_stop_are_bounded(spark, tmp_path, candidates, monkeypatch):
    """Windows double, and a streak that goes on in the next window is seen."""
    sent = []
    monkeypatch.setattr(run_module, "FIRST_WINDOW", 2)
    monkeypatch.setattr(run_module, "LARGEST_WINDOW", 8)
    failing = {f"text {i}" for i in (0, 4, 5, 7, 14, 15, 16, 17)}

    def respond(asked, stage):
        rows = asked.select("request_id", "ori_text").collect()
        sent.append(len(rows))
        told = [(r["request_id"], None, "timeout") if r["ori_text"] in failing else (r["request_id"], "fine", None) for r in rows]
        return spark.createDataFrame(told, "request_id string, text string, error string")

    run = Run(spark, str(tmp_path), "m", "d", respond)
    made = augmentation.generate(run, candidates, max_consecutive=3)
    assert sent == [2, 2, 4, 8, 8] and made.count() == 16
    failing.clear()
    assert augmentation.generate(run, candidates, max_consecutive=3).count() == 40


def test_repeated_ids_keep_their_own_texts(spark, tmp_path):
    def export(rows, name):
        run = Run(spark, str(tmp_path / name), "m", "d", client_responder(talking_client(), 2))
        out = augmentation.augment(run, spark.createDataFrame(rows, SCHEMA)).collect()
        return Counter((r["ori_text"], r["counter_text"], r["counter_label"]) for r in out)

    same = [("1", text, label, o) for _, text, label, o in TEXTS]
    assert export(same, "same") == export(TEXTS, "different")


def test_no_reply_is_a_failure(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "request_id string")
    asked = asked.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("request_id").alias("content"))))
    said = model.apply_model(asked, lambda: lambda messages: None if messages[0]["content"] == "a" else "x")
    assert {(r["request_id"], r["error"]) for r in said.collect()} == {("a", "empty reply"), ("b", None)}
    ready = spark.createDataFrame([("a", None, None)], "request_id string, text string, error string")
    joined = model.join_responses(asked, ready).collect()
    assert {(r["request_id"], r["error"]) for r in joined} == {("a", "empty reply"), ("b", "no response")}


def test_prefix_scores_end_where_final_scores_do(spark):
    rows = [(1, 2, i, "a" if i % 2 else "b", None if i % 5 == 0 else "a") for i in range(20)]
    table = spark.createDataFrame(rows, "seed int, shots int, ord bigint, y_true string, y_pred string")
    final = evaluation.macro_prf(table).first()
    last = evaluation.prefix_metrics(table, 5, bucket_rows=2).orderBy(F.desc("checkpoint")).first()
    for name in ("precision", "recall", "fscore", "accuracy"):
        assert last[name] == pytest.approx(final[name])


def test_any_number_of_label_names(spark):
    table = spark.range(19_000).select(F.format_string("%06d", "id").alias("label"))
    names = labels.label_map(table)
    assert names.select("masked").distinct().count() == 19_000
    first = {r["label"]: r["masked"] for r in names.filter("label < '000030'").collect()}
    assert first["000000"] == "concept A" and first["000025"] == "concept Z" and first["000026"] == "concept AA"


def test_no_labels_give_no_targets(spark):
    patterns = spark.createDataFrame(
        [("1", 0, "a", ["x"], 0)], "id string, pair_no int, ori_label string, phrases array<string>, ord bigint"
    )
    none = spark.createDataFrame([], "label string, first_ord bigint")
    assert labels.fan_out_targets(patterns, none).count() == 0
    odd = spark.createDataFrame([("b", None), ("c", 1)], "label string, first_ord bigint")
    got = {(r["target_label"], r["target_no"]) for r in labels.fan_out_targets(patterns, odd).collect()}
    assert got == {("b", 0), ("c", 1)}


def test_budget_says_what_it_leaves_out(spark, tmp_path):
    run = Run(spark, str(tmp_path), "m", "d", client_responder(talking_client(), 2))
    augmentation.augment(run, spark.createDataFrame(TEXTS, SCHEMA), token_limit=1)
    assert run.load("budget").first().asDict() == {"n_kept": 1, "n_left_out": 4}


def test_written_stages_leave_no_shuffle_files(spark, tmp_path):
    """A run of many stages needs the disk of one shuffle, and the user's own setting is as before."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(folders.CLEANUP, None)
    stages.write_stage(spark.range(10_000).repartition(7), str(tmp_path), "numbers", 1, "m", "d")
    end = time.monotonic() + 10
    while shuffled() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(folders.CLEANUP, None) == setting
    assert stages.read_stage(spark, str(tmp_path), "numbers", 1, "m", "d").count() == 10_000


def test_messages_are_made_after_places(spark, tmp_path, monkeypatch):
    """What numbers the calls moves no messages, and the calls that were asked are deleted once they are answered."""
    columns = "id string, ord long, pair_no int, phrase_no int, target_no int, ori_text string, ori_label string, target_label string, matched_phrase string, candidate_phrases array<string>"
    rows = [(str(i), i, 0, 0, 0, f"text {i}", "a", "b", "text", ["word"]) for i in range(300)]
    seen = []

    def respond(asked, stage):
        seen.append(asked.columns)
        return asked.select("request_id", F.lit("reply").alias("text"), F.lit(None).cast("string").alias("error"))

    placed, numbered = augmentation.dense_order, run_module.numbered
    monkeypatch.setattr(augmentation, "dense_order", lambda df, *a: seen.append(df.columns) or placed(df, *a))
    monkeypatch.setattr(run_module, "numbered", lambda df, *a: seen.append(df.columns) or numbered(df, *a))
    run = Run(spark, str(tmp_path), "m", "d", respond)
    made = augmentation.generate(run, spark.createDataFrame(rows, columns), max_consecutive=3)
    assert made.count() == 300 and "messages" not in seen[0] + seen[1] and "messages" in seen[2]
    assert not any(run.has(f"{held}_generation") for held in ("asked", "calls", "said"))


def test_rows_of_an_example_lie_side_by_side(spark, tmp_path):
    """Stages with an example's text in many rows hold these together, where their copies compress."""
    rows = [(str(i), f"the {w} is nice {i}", "food" if i % 2 else "price", i) for i, w in enumerate(["soup", "menu", "bread", "wine"] * 10)]
    run = Run(spark, str(tmp_path), "m", "d", client_responder(talking_client(), 2))
    labelled = spark.createDataFrame([*rows, ("x", "the view is nice", "view", 99), ("y", "the staff is nice", "staff", 98)], SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        augmentation.augment(run, labelled, None)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for stage in ("candidates", "counterfactuals", "filtered"):
        table = run.load(stage).select("ord", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
        held = [(r["file"], r["ord"]) for r in table.orderBy("place").collect()]
        changes = sum(a != b for a, b in zip(held, held[1:])) + 1
        assert len(held) > changes == len(set(held)) == len({o for _, o in held}), stage


def test_few_failures_are_not_walked(spark, monkeypatch):
    """Calls are walked in order only where so many failed that they may be in a row."""
    rows = [(i, "quota: 429" if i == 70 else "timeout" if i in (3, 4, 50, 51) else None) for i in range(90)]
    calls = spark.createDataFrame(rows, "ord bigint, error string")
    want = {most: runcontrol.stop_on_failures(calls, most, bucket_rows=16, carried=c).count() for most, c in ((2, 0), (3, 0))}
    assert want == {2: 4, 3: 70} and runcontrol.stop_on_failures(calls.filter("ord > 2"), 4, carried=2).count() == 1
    monkeypatch.setattr(runcontrol, "earlier", None)
    assert runcontrol.stop_on_failures(calls, 6).count() == 70
    assert runcontrol.stop_on_failures(calls.filter("ord < 60"), 9, carried=4).count() == 60


def test_a_look_for_answers_moves_no_texts(spark, tmp_path, candidates, monkeypatch):
    """What is compared with the stored answers are ids; answered and unanswered calls are told apart as before."""
    seen = []
    pending = run_module.pending
    monkeypatch.setattr(run_module, "pending", lambda df, *a: seen.append(set(df.columns)) or pending(df, *a))
    ill = Run(spark, str(tmp_path), "m", "d", client_responder(plain_client("text 7", "text 21")))
    augmentation.generate(ill, candidates)
    changed = candidates.withColumn("ori_text", F.when(F.col("ord") > 9, F.concat("ori_text", F.lit("!"))).otherwise(F.col("ori_text")))
    for well, fails in ((False, 1), (True, 0)):
        run = Run(spark, str(tmp_path), "m", "d", client_responder(plain_client()), attempt=1)
        made = augmentation.generate(run, changed, retry_failed=well).collect()
        assert Counter(r["counterfactual"] for r in made) == Counter({"fine": 40 - fails} | ({"": fails} if fails else {}))
    assert ill.store("generation").log_rows().count() == 40 + 20 + 1
    assert seen and all(columns <= {"ord", "request_id"} for columns in seen)


def test_tokens_by_words_are_those_of_calls(spark):
    signs = ["", " ", "a", "b c", "\n", " ", "\x1c", "dé ", " e", "a\n", "f ", "\U0001f600"]
    rows = [([("system", s), ("user", u)], r) for s in signs[:4] for u in signs for r in [None, *signs]]
    calls = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>, reply string")
    words, open_ = runcontrol.prompt_words(F.col("messages"))
    whole, parts = runcontrol.call_tokens(F.col("messages"), F.col("reply")), runcontrol.said_tokens(words, open_, F.col("reply"))
    assert calls.filter(~whole.eqNullSafe(parts)).count() == 0


def test_budget_goes_on_inside_an_example(spark, tmp_path):
    """Answered calls of an example are not asked again, waves write no messages, and the rows are those of a run without a budget."""
    columns = "id string, pair_no int, ori_text string, ori_label string, phrases array<string>, pattern string, ord bigint"
    patterns = spark.createDataFrame([(str(i), 0, f"text {i}", "abc"[i % 3], ["text", str(i)], f"text, {i}", i) for i in range(12)], columns)
    examples = patterns.select("id", F.col("ori_text").alias("text"), F.col("ori_label").alias("label"), "ord")

    def make():
        return lambda messages: f"1. {messages[-1]['content'][:40]} one\n2. other"

    def rows(df):
        return sorted(map(str, map(tuple, df.select("ord", "phrase_no", "target_label", "candidate_phrases").collect())))

    whole = Run(spark, str(tmp_path / "w"), "m", "d", client_responder(make))
    want = rows(augmentation.find_candidates(whole, patterns, examples))
    cut = Run(spark, str(tmp_path / "c"), "m", "d", client_responder(make), attempt=1)
    cut.store("candidates").append(whole.store("candidates").read().orderBy("request_id").limit(17))
    assert rows(augmentation.find_candidates(cut, patterns, examples, token_limit=10**9)) == want and len(want) == 48
    assert cut.store("candidates").log_rows().count() == 48 and not cut.has("asked_candidates")
