"""Whole runs with a Python client: model step, resume, gates, scores."""

import re

import pytest
from pyspark.sql import functions as F

from mirrorset.operators import model, runcontrol
from mirrorset.plans import augmentation, scoring
from mirrorset.plans.run import Run, client_responder

TEXTS = [
    ("1", "the soup was lovely", "food", 0),
    ("2", "the waiter was rude to us", "service", 1),
    ("3", "great pasta and bread", "food", 2),
    ("4", "staff never came back", "service", 3),
    ("5", "no label here", "none", 4),
    ("6", "prices are far too high", "price", 5),
]


def talking_client():
    """A client factory local to this call, so that workers get it by value."""

    def make_client():
        """Answers by the wording of the request; one sentence always fails."""

        def client(messages, temperature, max_tokens, stop):
            system, user = messages[0]["content"], messages[-1]["content"]
            if "words in a sentence" in system:
                lines = re.findall(r"^- (.+)$", user, re.M)
                return "\n".join(f"SENTENCE: {x}\nPHRASES: {x.split()[1]}\n---" for x in lines)
            if "replacement phrases" in system:
                return "Alternatives: alpha, beta"
            if "rewrite a sentence" in system:
                if "bread" in user and "'price'" in user:
                    raise RuntimeError("timeout")
                return f'"alpha {re.search("Sentence: (.+)", user)[1]}"'
            if "check rewritten" in system:
                return "No" if "staff" in user else "YES"
            if "classify sentences" in system:
                return "NO, YES"
            known = re.search(r"labels: (.+)\. Reply", system)[1].split(", ")
            return f" {known[len(messages[-1]['content']) % len(known)]}\n"

        return client

    return make_client


def forbidden_client():
    def make_client():
        raise AssertionError("no request should reach the model")

    return make_client


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    examples = spark.createDataFrame(TEXTS, "id string, text string, label string, ord bigint")
    run = Run(spark, root, "test:model", "demo", client_responder(talking_client(), 2))
    return run, examples, augmentation.augment(run, examples)


def test_patterns(setup):
    run, _, _ = setup
    rows = run.load("patterns").collect()
    assert {(r["id"], r["pattern"], r["match"]) for r in rows} == {
        ("1", "soup", "exact"), ("2", "waiter", "exact"), ("3", "pasta", "exact"),
        ("4", "never", "exact"), ("6", "are", "exact"),
    }


def test_candidates_cover_every_other_label(setup):
    run, _, _ = setup
    rows = run.load("candidates").collect()
    assert len(rows) == 10
    assert all(r["target_label"] != r["ori_label"] and r["candidate_phrases"] == ["alpha", "beta"] for r in rows)


def test_failed_rewrite_is_kept_empty_and_filtered(setup):
    run, _, _ = setup
    failed = [r for r in run.load("filtered").collect() if r["error"] is not None]
    assert [(r["id"], r["target_label"], r["counterfactual"]) for r in failed] == [("3", "price", "")]
    assert failed[0]["heuristic_filtered"] is False and failed[0]["matched_pattern"] is None


def test_export_holds_accepted_rows_only(setup):
    run, _, export = setup
    rows = export.collect()
    assert len(rows) == 7
    assert all(r["id"] != "4" for r in rows)
    assert all(r["counter_text"].startswith("alpha ") for r in rows)
    skipped = [r for r in run.load("filtered").collect() if r["id"] == "4"]
    assert all(r["matched_pattern"] is False and r["is_ori"] is None for r in skipped)


def test_second_run_asks_nothing(setup):
    run, examples, export = setup
    again = Run(run.spark, run.root, run.model, run.dataset, client_responder(forbidden_client()))
    before = sorted(map(tuple, export.collect()))
    assert sorted(map(tuple, augmentation.augment(again, examples).collect())) == before


def test_cut_run_goes_on_by_key(setup, spark, tmp_path):
    """Whatever subset was answered before, the rest is asked and the result is whole."""
    from mirrorset.operators import requests
    from mirrorset.sources import stages

    run, _, _ = setup
    asked = requests.generation_requests(run.load("candidates"))
    whole = Run(spark, str(tmp_path / "w"), "m", "d", client_responder(talking_client()), chunks=3)
    want = sorted((r["request_id"], r["text"], r["error"]) for r in whole.answers(asked, "generation").collect())
    cut = Run(spark, str(tmp_path / "c"), "m", "d", client_responder(talking_client()))
    some = stages.read_results(spark, whole.root, "answers_generation_42_m_d").orderBy("request_id").limit(4)
    stages.append_results(some, cut.root, "answers_generation_42_m_d")
    got = sorted((r["request_id"], r["text"], r["error"]) for r in cut.answers(asked, "generation").collect())
    assert got == want and len(got) == 10
    assert cut.store("generation").log_rows().count() == 10


def test_generation_stops_where_a_caller_would(setup, spark, tmp_path):
    run, _, _ = setup
    candidates = run.load("candidates").cache()

    def picky():
        def client(messages, **_):
            if "'price'" in messages[-1]["content"]:
                raise RuntimeError("timeout")
            return "fine"

        return client

    other = Run(spark, str(tmp_path), "m", "d", client_responder(lambda: picky()))
    order = ["ord", "pair_no", "phrase_no", "target_no"]
    rows = [r["target_label"] for r in candidates.orderBy(order).collect()]
    failed = ["price" in (r["target_label"], r["ori_label"]) for r in candidates.orderBy(order).collect()]
    want = next(i for i in range(len(rows)) if i and failed[i] and failed[i - 1])
    kept = augmentation.generate(other, candidates, max_consecutive=2).orderBy(order).collect()
    assert [r["target_label"] for r in kept] == rows[:want]
    assert [r["counterfactual"] for r in kept] == ["" if f else "fine" for f in failed[:want]]


def test_failed_calls_are_asked_again_on_demand(setup):
    run, _, _ = setup
    from mirrorset.operators import requests

    asked = requests.generation_requests(run.load("candidates"))
    fixed = Run(
        run.spark, run.root, run.model, run.dataset,
        client_responder(lambda: lambda messages, **_: "fixed"), attempt=1,
    )
    rows = fixed.answers(asked, "generation", retry_failed=True).collect()
    assert sum(r["text"] == "fixed" for r in rows) == 1 and all(r["error"] is None for r in rows)


def test_budget_counts_prompts_and_replies(setup, spark, tmp_path):
    """Waves end where a caller would that adds up each call's prompt and reply, example by example."""
    run, examples, _ = setup
    patterns = run.load("patterns")
    whole = augmentation.requests.candidate_requests(
        augmentation.fan_out_targets(patterns, augmentation.label_domain(examples))
    )
    replies = whole.withColumn("text", F.concat(F.lit("alpha, beta"), F.repeat(F.lit(" word"), F.col("ord").cast("int") * 40)))
    cost = runcontrol.call_tokens(F.col("messages"), F.col("text"))
    each = sorted((r["ord"], r["n"]) for r in replies.groupBy("ord").agg(F.sum(cost).alias("n")).collect())

    def respond(asked, stage):
        return asked.join(replies.select("ord", "phrase_no", "target_label", "text"), ["ord", "phrase_no", "target_label"]).select(
            "request_id", "text", F.lit(None).cast("string").alias("error")
        )

    for number, limit in enumerate((0, each[0][1], each[0][1] + 1, sum(n for _, n in each) - 1, 10**9)):
        spent, want = 0, []
        for ord_, n in each:
            if spent <= limit:
                want.append(ord_)
                spent += n
        fresh = Run(spark, str(tmp_path / str(number)), "m", "d", respond)
        got = augmentation.find_candidates(fresh, patterns, examples, token_limit=limit)
        assert sorted(r["ord"] for r in got.select("ord").distinct().collect()) == want
        assert fresh.load("budget").first()["n_kept"] == len(want)


def test_client_is_told_what_it_takes(spark):
    asked = spark.createDataFrame([("r",)], "request_id string").withColumn(
        "messages", F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")))
    )
    asked = augmentation.requests.request_params(asked, "generation", "gpt-5-nano")

    def short():
        return lambda messages, max_tokens: f"{max_tokens}"

    def full():
        return lambda messages, **settings: str(sorted(settings.items()))

    assert model.apply_model(asked, short).first()["text"] == "1024"
    told = model.apply_model(asked, full).first()["text"]
    assert "('reasoning_effort', 'low')" in told and "('token_field', 'max_completion_tokens')" in told


def test_scores(setup, spark):
    run, _, _ = setup
    test = spark.createDataFrame(
        [("a", "xx", "food", 0), ("b", "xxx", "price", 1), ("c", "x", "other", 2), ("d", "xxxx", "service", 3)],
        "id string, text string, label string, ord bigint",
    )
    rows = scoring.score(run, run.load("filtered"), test, shots=(2, 4, 50), seeds=(1, 42)).collect()
    assert {(r["seed"], r["shots"], r["test_size"]) for r in rows} == {
        (s, n, 3) for s in (1, 42) for n in (2, 4)
    }
    contexts = run.load("contexts").collect()
    for c in contexts:
        roles = [m["role"] for m in c["messages"]]
        assert roles == ["system"] + ["user", "assistant"] * c["n_examples"]
        assert "concept A, concept B, concept C" in c["messages"][0]["content"]


def test_rendered_contexts_are_the_rendered_messages(spark):
    from mirrorset.functions import messages as m
    from mirrorset.operators.requests import attach_context

    kind = "array<struct<role:string,content:string>>"
    contexts = spark.createDataFrame(
        [(1, 10, [("system", "é\nx"), ("user", None), ("assistant", "")]), (1, 15, [("system", None)]), (1, 30, []), (2, 10, None)],
        f"seed int, shots int, messages {kind}",
    )
    rows = [(s, k, f"{s}{k}{i}", q) for s, k in ((1, 10), (1, 15), (1, 30), (2, 10)) for i, q in enumerate(("", "ö a", None))]
    asked = spark.createDataFrame(rows, "seed int, shots int, request_id string, query string")
    for chars in (10_000, 0):
        whole = attach_context(asked, contexts, chars)
        text = m.render(F.col("messages"))
        told = attach_context(asked, contexts, chars, rendered="r")
        wanted = whole.select("request_id", text.alias("r"), F.length(text).alias("n")).collect()
        assert sorted(map(str, told.select("request_id", "r", F.col("r_chars").alias("n")).collect())) == sorted(map(str, wanted))
        assert len(wanted) == 12


def test_content_ids_take_queries_by_their_digest(spark):
    from mirrorset.operators.requests import content_ids, scoring_requests

    test = spark.createDataFrame([("a", 0, "x", "l"), ("b", 1, None, "l"), ("c", 2, "", "l")], "id string, ord long, text string, label string")
    asked = scoring_requests(test, (10, 15)).withColumn("context_id", F.lit("c")).withColumn("request_id", F.lit("r"))
    ids = {(r["test_id"], r["shots"]): r["request_id"] for r in content_ids(asked.drop("query")).collect()}
    assert len({ids[t, 10] for t in "abc"}) == 3 and all(ids[t, 10] == ids[t, 15] for t in "abc")
