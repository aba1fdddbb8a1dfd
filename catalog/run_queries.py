"""Runs that stop, fail and go on: answer stores, budgets, stop rules, versions of stages, earlier results."""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.functions import messages as m
from mirrorset.operators import requests, runcontrol
from mirrorset.operators.labels import fan_out_targets, label_domain
from mirrorset.plans import augmentation
from mirrorset.plans.run import ClientResponder, Run
from mirrorset.sources import stages
from mirrorset.sources.answers import AnswerStore
from mirrorset.sources.examples import import_candidates as imported

from . import doubles as d
from . import views as v
from .registry import ORACLES, query
from .request_queries import _NEW, _STORED, _event_answers, _filled

_FAILED = (PySparkException, Py4JJavaError)


def _run(spark: SparkSession, root: str, respond, attempt: int = 0) -> Run:
    return Run(spark, root, "double", "documents", respond, v.SEED, attempt)


# --- answers -------------------------------------------------------------------


@query("SELECT id, length(text) || ' ' || left(text, 12) AS reply, CAST(1 AS BIGINT) AS n_answers FROM examples", "examples")
def resume_failed_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks die midway at some documents; the next run asks what their logs do not hold. One answer a document."""
    texts = v.examples(spark, sf_dir)
    asked = texts.select(
        m.request_id("generation", F.col("ord")).alias("request_id"), "id", F.array(m.message("user", F.col("text"))).alias("messages")
    )

    def client_of(dies: bool):
        def make_client():
            def client(messages, temperature, max_tokens, stop):
                text = messages[0]["content"]
                if dies and hashlib.md5(text.encode()).hexdigest() < "04":
                    raise SystemExit("the machine is gone")
                return f"{len(text)} {text[:12]}"

            return client

        return make_client

    root = stages.shared_folder(spark)
    for dies in (True, False):
        run = _run(spark, root, ClientResponder(client_of(dies), flush_calls=10))
        try:
            answered = run.answers(asked, "generation")
        except _FAILED:
            if not dies:
                raise
    given = run.store("generation").log_rows().groupBy("request_id").agg(F.count(F.lit(1)).alias("n_answers"))
    return answered.join(given, "request_id").select("id", F.col("text").alias("reply"), "n_answers")


@query(
    f"""
    SELECT request_id, coalesce(CASE WHEN {_STORED} < 'c' THEN text END, CASE WHEN {_NEW} < 'c' THEN 'retried ' || ord END) AS text,
      CASE WHEN {_STORED} < 'c' AND text IS NOT NULL OR {_NEW} < 'c' THEN NULL ELSE error END AS error, CAST(1 AS BIGINT) AS n_stored
    FROM answers WHERE {_STORED} < 'c' OR {_NEW} < 'c'
    """,
    "answers",
)
def compact_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three runs in one store, whose piled-up files are merged to one answer a request."""
    store = AnswerStore(spark, f"{stages.shared_folder(spark)}/answers")
    calls = _event_answers(spark, sf_dir)
    again = calls.filter(d.digit("new", "ord") < "c").select(
        "request_id", F.concat(F.lit("retried "), F.col("ord").cast("string")).alias("text"), F.lit(None).cast("string").alias("error")
    )
    store.append(calls.filter(d.digit("stored", "ord") < "c"), 0)
    for run in (1, 2):
        store.append(again, run)
    store.compact(pile=3)
    held = store.log_rows().groupBy("request_id").agg(F.count(F.lit(1)).alias("n_stored"))
    return store.read().join(held, "request_id")


@query("SELECT id, text, label, ord FROM examples", "examples")
def stage_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of a stage, then a write over it that fails midway: readers keep the whole one."""
    key = (stages.shared_folder(spark), "examples", v.SEED, "double", "documents")
    rows = v.examples(spark, sf_dir)
    stages.write_stage(rows, *key)
    broken = F.when(d.digit("broken", "id") == "0", F.raise_error(F.lit("midway"))).otherwise(F.lit("other"))
    try:
        stages.write_stage(rows.withColumn("text", broken.cast("string")), *key)
    except _FAILED:
        pass
    return stages.read_stage(spark, *key)


# --- budgets and stops ---------------------------------------------------------


@query(
    """
    SELECT ord, CAST(tokens AS BIGINT) AS tokens, CAST(spent AS BIGINT) AS spent FROM (
      SELECT ord, tokens, coalesce(sum(tokens) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
      FROM (SELECT epoch_us(ts) AS ord, sum(CAST(floor(value) AS BIGINT)) AS tokens FROM events GROUP BY epoch_us(ts)))
    WHERE spent <= (SELECT sum(CAST(floor(value) AS BIGINT)) // 2 FROM events)
    """
)
def token_budget_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget along times in microseconds: half of all tokens, in order of the events."""
    calls = v.table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"), F.floor("value").alias("tokens"))
    limit = calls.agg(F.sum("tokens")).first()[0] // 2
    return runcontrol.within_budget(calls, limit=limit, bucket_rows=256)


def _tokens(text: str) -> str:
    return rf"CAST(floor(len(regexp_extract_all({text}, '\S+')) * CAST(1.3 AS DOUBLE)) AS BIGINT)"


_PROMPT = (
    _filled(m.CANDIDATE_SYSTEM)
    + " || ' ' || "
    + _filled(m.CANDIDATE_USER, text="ori_text", phrase="matched_phrase", label="ori_label", target="target_label")
)


def _budget_sql(select: str) -> str:
    before = "coalesce(sum(t) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""
      WITH calls AS (SELECT ord, {_tokens("p")} AS prompt, CASE WHEN reply IS NULL THEN 0 ELSE {_tokens("p || reply")} END AS t
          FROM (SELECT *, {_PROMPT} AS p FROM candidate_replies)),
        bound AS (SELECT sum(prompt) // 4 AS most FROM calls),
        each AS (SELECT ord, sum(t) AS t FROM calls GROUP BY ord),
        first_run AS (SELECT max(ord) AS last FROM (SELECT ord, {before} AS spent FROM each) WHERE spent <= (SELECT most FROM bound)),
        second_run AS (SELECT max(ord) AS last FROM (SELECT ord, {before} AS spent FROM each WHERE ord > (SELECT last FROM first_run))
          WHERE spent <= (SELECT most FROM bound))
      {select}
    """


@query(
    f"""SELECT * FROM ({_budget_sql('''
      SELECT id, phrase_no, target_label, array_to_string(candidate_phrases, ' | ') AS phrases, c.ord <= (SELECT last FROM first_run) AS first_run
      FROM candidates c WHERE c.ord <= greatest((SELECT last FROM first_run), coalesce((SELECT last FROM second_run), -1))
    ''')})""",
    "candidates candidate_replies",
)
def budgeted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates while prompts and replies of a run cost a quarter of all prompts, and those of the run after it."""
    patterns, examples = v.patterns(spark, sf_dir), v.examples(spark, sf_dir)
    asked = requests.candidate_requests(fan_out_targets(patterns, label_domain(examples)))
    limit = asked.agg(F.sum(runcontrol.call_tokens(F.col("messages"), F.lit("")))).first()[0] // 4
    root = stages.shared_folder(spark)
    for attempt in (0, 1):
        made = augmentation.find_candidates(_run(spark, root, v.respond, attempt), patterns, examples, token_limit=limit)
        if attempt == 0:
            last = made.agg(F.max("ord")).first()[0]
    return made.select("id", "phrase_no", "target_label", F.array_join("candidate_phrases", " | ").alias("phrases"), (F.col("ord") <= last).alias("first_run"))


_GONE = "(d = '0' OR ord % 40 = 20)"


@query(
    f"""
    SELECT id, phrase_no, target_label, CASE WHEN place < cut AND ord % 40 = 20 THEN '' ELSE counterfactual END AS counterfactual,
      d = '0' OR place < cut AND ord % 40 = 20 AS failed
    FROM (
      SELECT *, min(CASE WHEN place >= cut AND later >= 5 THEN place END) OVER () AS over FROM (
        SELECT *, place - greatest(cut - 1, coalesce(max(CASE WHEN d <> '0' THEN place END) OVER (ORDER BY place), -1)) AS later FROM (
          SELECT *, coalesce(min(CASE WHEN streak >= 5 THEN place END) OVER (), 9223372036854775807) AS cut FROM (
            SELECT *, place - coalesce(max(CASE WHEN NOT {_GONE} THEN place END) OVER (ORDER BY place), -1) AS streak FROM (
              SELECT *, {d.digit_sql('gen', 'id', 'phrase_no', 'target_label')} AS d,
                row_number() OVER (ORDER BY {v.ROW_ORDER_SQL}) - 1 AS place FROM counterfactuals)))))
    WHERE over IS NULL OR place < over
    """,
    "counterfactuals",
)
def generate_stop_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation that stops at five failures in a row, and a second run that goes on to the end."""
    root, asked = stages.shared_folder(spark), v.staged(v.candidates(spark, sf_dir), "candidates")

    def ill(wanted: DataFrame, stage: str) -> DataFrame:
        gone = wanted.select("request_id", (F.col("ord") % 40 == 20).alias("_gone"))
        said = v.respond(wanted, stage).join(gone, "request_id")
        error = F.when(F.col("_gone"), F.lit("timeout")).otherwise(F.col("error"))
        return said.select("request_id", F.when(~F.col("_gone"), F.col("text")).alias("text"), error.alias("error"))

    for attempt, respond in enumerate((ill, v.respond)):
        made = augmentation.generate(_run(spark, root, respond, attempt), asked, max_consecutive=5)
    return made.select("id", "phrase_no", "target_label", "counterfactual", F.col("error").isNotNull().alias("failed"))


# --- earlier results and repeated ids ------------------------------------------


@query(
    f"""
    SELECT id, phrase_no, target_label, CASE WHEN {d.digit_sql('plain', 'id', 'target_label')} < '4' THEN 'plain ' || matched_phrase
      ELSE array_to_string(candidate_phrases, ' | ') END AS phrases FROM candidates
    """,
    "candidates",
)
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as list text, some as plain text, and taken in again."""
    def written(p):
        for sign, code in (("\\", "\\\\"), ("\n", "\\n")):
            p = F.replace(p, F.lit(sign), F.lit(code))
        single = F.concat(F.lit("'"), F.replace(p, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(p.contains("'") & ~p.contains('"'), F.concat(F.lit('"'), p, F.lit('"'))).otherwise(single)

    listed = F.concat(F.lit("["), F.array_join(F.transform("candidate_phrases", written), ", "), F.lit("]"))
    plain = d.digit("plain", "id", "target_label") < "4"
    rows = v.candidates(spark, sf_dir).withColumn(
        "candidate_phrases", F.when(plain, F.concat(F.lit("plain "), "matched_phrase")).otherwise(listed)
    )
    return imported(rows).select("id", "phrase_no", "target_label", F.array_join("candidate_phrases", " | ").alias("phrases"))


@query()
def augment_run_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over every sentence where a hundred ids are shared."""
    rows = v.sentences(spark, sf_dir).withColumn("id", (F.col("ord") % 100).cast("string"))
    return augmentation.augment(_run(spark, stages.shared_folder(spark), v.respond), rows, None)


ORACLES["augment_run_repeated_ids"] = v.with_repeated_ids(ORACLES["augment_run"], 100)
