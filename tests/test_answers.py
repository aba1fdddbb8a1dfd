"""The answer store, the log ahead of it, and stages that fail midway."""

import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mirrorset.operators import model, runcontrol
from mirrorset.plans.run import ClientResponder, Run
from mirrorset.sources import stages
from mirrorset.sources.answers import ANSWER, AnswerLog, AnswerStore

FAILED = (PySparkException, Py4JJavaError)
ANSWERS = "request_id string, text string, error string"


def asked(spark, n=40):
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content")))
    return spark.range(n).select(F.md5(F.col("id").cast("string")).alias("request_id"), F.col("id"), said.alias("messages"))


def failing_client(folder, at, kill=False):
    """Notes each call in a file; dies once at a message, as if its machine did."""

    def make():
        def client(messages, **_):
            text = messages[0]["content"]
            with open(f"{folder}/{text}", "a") as note:
                note.write("x")
            if text in at and not os.path.exists(f"{folder}/died-{text}"):
                open(f"{folder}/died-{text}", "w").close()
                if kill:
                    os._exit(1)
                raise SystemExit("gone")
            return f"answer {text}"

        return client

    return make


@pytest.mark.parametrize("kill", [False, True])
def test_a_task_that_fails_midway_keeps_its_answers(spark, tmp_path, kill):
    """Each request is answered once; only the call that died is made again."""
    notes = tmp_path / "notes"
    notes.mkdir()
    dying = ["7", "31"]
    respond = ClientResponder(failing_client(str(notes), dying, kill), 3, flush_calls=1)
    run = Run(spark, str(tmp_path / "run"), "m", "d", respond)
    for _ in dying + ["whole"]:
        try:
            got = run.answers(asked(spark), "generation")
            break
        except FAILED:
            assert not run.store("generation").exists() or run.store("generation").log_rows().count() < 40
    rows = {r["id"]: r["text"] for r in got.collect()}
    assert rows == {i: f"answer {i}" for i in range(40)}
    assert run.store("generation").log_rows().count() == 40
    calls = {p.name: len(p.read_text()) for p in notes.iterdir() if not p.name.startswith("died")}
    assert {t: n for t, n in calls.items() if n != 1} == {t: 2 for t in dying}


def test_a_task_tried_again_reads_its_log(spark, tmp_path):
    log = AnswerLog(str(tmp_path / "log"), flush_calls=2)
    first = log.of_task(0)
    for i in range(3):
        first.add(f"{i}", f"logged {i}", None)
    first.flush()
    (tmp_path / "log/p000000/_half.parquet").write_bytes(b"PAR1")
    assert [t.num_rows for t in log.of_task(0).earlier()] == [2, 1] and not list(log.of_task(1).earlier())
    assert next(log.of_task(0).earlier()).schema == ANSWER
    table = spark.createDataFrame([(str(i), [{"role": "user", "content": str(i)}]) for i in range(5)], "request_id string, messages array<struct<role:string,content:string>>")

    def make():
        return lambda messages: f"asked {messages[0]['content']}"

    got = {r["request_id"]: r["text"] for r in model.apply_model(table.coalesce(1), make, log=log).collect()}
    assert got == {"0": "logged 0", "1": "logged 1", "2": "logged 2", "3": "asked 3", "4": "asked 4"}


def test_lost_logs_are_taken_in_once(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "s"), 3)
    task = store.log().of_task(4)
    for i in range(3):
        task.add(f"{i}", None if i == 1 else "x", "timeout" if i == 1 else None)
    task.flush()
    store.append(spark.createDataFrame([("0", "x", None)], ANSWERS), run=0)
    store.recover(0)
    store.recover(0)
    assert sorted(tuple(r) for r in store.read().collect()) == [("0", "x", None), ("1", None, "timeout"), ("2", "x", None)]
    assert store.log_rows().count() == 3


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip() for x in plan.split("== Initial Plan ==")[0].splitlines() if "Exchange" in x]


def test_stored_answers_are_not_shuffled(spark, tmp_path):
    """Only requests move, also where the same request was answered by several runs."""
    store = AnswerStore(spark, str(tmp_path / "s"), 8)
    rows = asked(spark, 500).select("request_id", F.lit("x").alias("text"), F.lit(None).cast("string").alias("error"))
    store.append(rows.limit(300), 0)
    store.append(rows.limit(400), 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        todo = runcontrol.pending(asked(spark, 500), store.read())
        joined = model.join_responses(asked(spark, 500).select("request_id"), store.read())
        for df, n in ((todo, 100), (joined, 500)):
            assert df.count() == n
            assert [x for x in exchanges(df) if "hashpartitioning(request_id" in x] == exchanges(df)
            assert len(exchanges(df)) == 1
        assert exchanges(store.read()) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_piles_are_merged(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "s"), 2)
    rows = asked(spark, 30).select("request_id", F.lit("x").alias("text"), F.lit(None).cast("string").alias("error"))
    for run in range(3):
        store.append(rows.withColumn("text", F.lit(f"run {run}")), run)
    old = store.read()
    assert not store.compact(9) and store.pile() == 3 and store.compact(3) and store.pile() == 1
    assert store.log_rows().count() == 30 and {r["text"] for r in store.read().collect()} == {"run 0"}
    assert old.count() == 30  # readers of the version before go on
    store.append(rows.limit(1), 5)
    assert AnswerStore(spark, str(tmp_path / "s"), 99).log_rows().count() == 31


def test_a_write_that_fails_leaves_the_run_before(spark, tmp_path):
    key = (str(tmp_path), "s", 42, "m", "d")
    rows = spark.range(100).select("id", F.lit("first").alias("text"))
    stages.write_stage(rows, *key)
    broken = F.when(F.col("id") == 99, F.raise_error(F.lit("midway"))).otherwise(F.lit("second"))
    with pytest.raises(FAILED, match="midway"):
        stages.write_stage(rows.repartition(5).withColumn("text", broken), *key)
    assert {r["text"] for r in stages.read_stage(spark, *key).collect()} == {"first"}
    assert {r["text"] for r in stages.read_runs(spark, key[0], "s").collect()} == {"first"}
    again = stages.read_stage(spark, *key).withColumn("text", F.lit("third"))
    stages.write_stage(again, *key)  # out of its own last version
    stages.write_stage(stages.read_stage(spark, *key), *key)
    assert {r["text"] for r in stages.read_stage(spark, *key).collect()} == {"third"}
