"""Request tables, message dialect, parameters, responses, resume and run control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.functions import messages as m
from mirrorset.operators import labels, model, requests, runcontrol
from mirrorset.plans import scoring
from mirrorset.sources import stages
from mirrorset.sources.answers import AnswerStore

from . import doubles as d
from . import views as v
from .registry import query, view


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, **fields: str) -> str:
    """SQL concat of a prompt template."""
    out, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [_quoted(before), fields[name]]
    return " || ".join([*out, _quoted(rest)])


def _rendered(system: str, user: str, **fields: str) -> str:
    return f"'system: ' || {_filled(system, **fields)} || chr(10) || 'user: ' || {_filled(user, **fields)}"


def _request_id(stage: str, *keys: str) -> str:
    parts = ", ".join(f"length(CAST({k} AS VARCHAR)), {k}" for k in keys)
    return f"md5(concat_ws(':', '{stage}', {parts}))"


_ROW_ID = ("ord", "pair_no", "phrase_no", "target_label")


def _request_sql(stage: str, keys: tuple[str, ...], text: str, source: str, keep: str) -> str:
    return f"""
      SELECT {_request_id(stage, *keys)} AS request_id, {keep}, md5(t) AS messages_md5, CAST(length(t) AS INTEGER) AS n_chars
      FROM (SELECT *, {text} AS t FROM {source})
    """


@query(
    _request_sql(
        "pattern",
        ("label", "batch_no"),
        _rendered(m.PATTERN_SYSTEM, m.PATTERN_USER, label="label", lines="lines"),
        "(SELECT label, batch_no, string_agg('- ' || text, chr(10) ORDER BY pos) AS lines FROM batched GROUP BY label, batch_no)",
        "label, batch_no",
    ),
    "batched",
)
def pattern_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.message_hash(requests.pattern_requests(v.batches(spark, sf_dir)), "request_id", "label", "batch_no")


@query(
    _request_sql(
        "candidates",
        _ROW_ID,
        _rendered(
            m.CANDIDATE_SYSTEM, m.CANDIDATE_USER,
            text="ori_text", phrase="matched_phrase", label="ori_label", target="target_label",
        ),
        "fan_out",
        "id, phrase_no, target_label",
    ),
    "fan_out",
)
def candidate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests.candidate_requests(v.fan_out(spark, sf_dir))
    return v.message_hash(asked, "request_id", "id", "phrase_no", "target_label")


@query(
    _request_sql(
        "generation",
        _ROW_ID,
        _rendered(
            m.GENERATION_SYSTEM, m.GENERATION_USER,
            text="ori_text", label="ori_label", target="target_label", phrases="array_to_string(candidate_phrases, ', ')",
        ),
        "candidates",
        "id, phrase_no, target_label",
    ),
    "candidates",
)
def generation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests.generation_requests(v.candidates(spark, sf_dir))
    return v.message_hash(asked, "request_id", "id", "phrase_no", "target_label")


@query(
    "SELECT 'semantic' AS gate, * FROM ("
    + _request_sql(
        "semantic",
        _ROW_ID,
        _rendered(
            m.SEMANTIC_SYSTEM, m.SEMANTIC_USER,
            text="ori_text", phrase="matched_phrase", phrases="array_to_string(candidate_phrases, ', ')", counterfactual="counterfactual",
        ),
        "filtered WHERE heuristic_filtered",
        "id, phrase_no, target_label",
    )
    + ") UNION ALL SELECT 'discriminator', * FROM ("
    + _request_sql(
        "discriminator",
        _ROW_ID,
        _rendered(
            m.DISCRIMINATOR_SYSTEM, m.DISCRIMINATOR_USER,
            counterfactual="counterfactual", label="ori_label", target="target_label",
        ),
        "filtered WHERE heuristic_filtered AND matched_pattern",
        "id, phrase_no, target_label",
    )
    + ")",
    "filtered",
)
def gate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of both model gates; each gate asks only about rows let through so far."""
    rows = v.filtered(spark, sf_dir)
    keep = ("request_id", "id", "phrase_no", "target_label")
    first = v.message_hash(requests.semantic_requests(rows), *keep).withColumn("gate", F.lit("semantic"))
    second = v.message_hash(requests.discriminator_requests(rows), *keep).withColumn("gate", F.lit("discriminator"))
    return first.unionByName(second)


# --- few-shot contexts -------------------------------------------------------

_SHOTS = (5, 10, 30)
view(
    "context_rows",
    f"""
    WITH first AS (SELECT id, ori_text, ori_label FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY {v.ROW_ORDER_SQL}) AS k FROM filtered) WHERE k = 1),
      chosen AS (SELECT seed, shots, rn, id, ori_text, ori_label FROM (
          SELECT 42 AS seed, *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', id)), id) AS rn FROM first),
          (SELECT unnest([{', '.join(map(str, _SHOTS))}]) AS shots)
        WHERE rn <= shots AND shots <= (SELECT count(*) FROM first)),
      few AS (SELECT * FROM (
          SELECT id, counterfactual, target_label, row_number() OVER (PARTITION BY id ORDER BY {v.ROW_ORDER_SQL}) AS sub
          FROM filtered WHERE {v.ACCEPTED_SQL}) WHERE sub <= 4)
    SELECT seed, shots, rn, 0 AS sub, ori_text AS text, ori_label AS label FROM chosen
    UNION ALL SELECT seed, shots, rn, sub, counterfactual, target_label FROM chosen JOIN few USING (id)
    """,
    "filtered",
)
view(
    "contexts",
    f"""
    SELECT seed, shots, count(*) AS n_examples,
      'system: ' || {_filled(m.SCORING_SYSTEM, labels="(SELECT string_agg(masked, ', ' ORDER BY label) FROM label_map)")} || chr(10)
        || string_agg('user: ' || text || chr(10) || 'assistant: ' || masked, chr(10) ORDER BY rn, sub) AS rendered
    FROM context_rows JOIN label_map USING (label) GROUP BY seed, shots
    """,
    "context_rows label_map",
)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts out of the filtered table, written once as a stage since two steps read it."""
    rows = v.staged(v.filtered(spark, sf_dir), "filtered")
    return scoring.build_contexts(rows, v.label_map(spark, sf_dir), _SHOTS, (42,))


@query(
    "SELECT seed, shots, n_examples, md5(rendered) AS messages_md5, CAST(length(rendered) AS INTEGER) AS n_chars FROM contexts",
    "contexts",
)
def few_shot_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.message_hash(_contexts(spark, sf_dir), "seed", "shots", "n_examples")


@query(
    f"""
    SELECT {_request_id('scoring', 'seed', 'shots', 'test_id')} AS request_id, seed, shots, test_id,
      md5(rendered || chr(10) || 'user: ' || text) AS messages_md5, CAST(length(rendered) + 7 + length(text) AS INTEGER) AS n_chars
    FROM (SELECT id AS test_id, text FROM examples WHERE label <> 'es'), contexts
    """,
    "contexts",
)
def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known test row with the contexts of all shot sizes."""
    known = labels.known_labels(v.examples(spark, sf_dir), v.label_map(spark, sf_dir, ("es",)))
    asked = requests.scoring_requests(known, _SHOTS, (42,))
    contexts = v.staged(_contexts(spark, sf_dir), "contexts")
    full = requests.attach_context(asked, contexts, rendered="rendered")
    return v.message_hash(full, "request_id", "seed", "shots", "test_id")


# --- messages and settings ---------------------------------------------------

@query(
    f"""
    SELECT id, CASE WHEN d < '4' THEN label WHEN d < '8' THEN NULL ELSE source END AS system,
      'user: ' || text || chr(10) || 'model: ' || source AS contents
    FROM (SELECT e.*, source, {d.digit_sql('sys', 'e.id')} AS d FROM examples e JOIN documents ON doc_id = e.ord)
    """,
    "examples",
)
def message_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lists with zero to two system messages and a stray role."""
    draw = d.digit("sys", "id")
    df = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", "source", "lang"
    )
    turns = F.array(
        m.message("system", F.col("lang")),
        m.message("user", F.col("text")),
        m.message("tool", F.lit("ignored")),
        m.message("assistant", F.col("source")),
    )
    last = F.array(m.message("system", F.when(draw < "8", F.lit("")).otherwise(F.col("source"))))
    messages = F.when(draw < "4", turns).otherwise(F.concat(turns, last))
    out = df.select("id", m.to_dialect(messages).alias("_o"))
    return out.select("id", "_o.system", m.render(F.col("_o.contents")).alias("contents"))


@query(
    """
    SELECT c.conv_id, c.turn, CASE c.role WHEN 'assistant' THEN 'model' ELSE c.role END AS role, c.text AS content, s.system
    FROM conversations c LEFT JOIN (
      SELECT conv_id, nullif(arg_max(text, turn), '') AS system FROM conversations WHERE role = 'system' GROUP BY conv_id) s
      ON s.conv_id = c.conv_id
    WHERE c.role IN ('user', 'assistant')
    """
)
def message_dialect_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.dialect_turns(v.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_STAGES = list(m.STAGE_DEFAULTS)
_MODELS = ["gpt-5-nano", "GPT-4o-mini", "qwen:7b-chat"]


@query(
    f"""
    SELECT stage, model, count(*) AS n_requests,
      CAST(CASE WHEN fixed THEN 1.0 ELSE CASE stage WHEN 'scoring' THEN 0.0 ELSE 1.0 END END AS DOUBLE) AS temperature,
      CASE stage WHEN 'pattern' THEN 4096 WHEN 'candidates' THEN 2048 WHEN 'generation' THEN 1024
        WHEN 'semantic' THEN 512 WHEN 'discriminator' THEN 256 ELSE 4096 END AS max_tokens,
      CASE WHEN NOT fixed AND stage IN ('generation', 'scoring') THEN chr(10) END AS stop,
      CASE WHEN fixed THEN 'max_completion_tokens' ELSE 'max_tokens' END AS token_field,
      CASE WHEN fixed THEN 'low' END AS reasoning_effort
    FROM (SELECT stage, model, contains(lower(model), 'gpt-5') OR contains(lower(model), 'gpt-4o') AS fixed FROM (
      SELECT ({_STAGES})[event_id % 6 + 1] AS stage, ({_MODELS})[event_id % 7 % 3 + 1] AS model FROM events))
    GROUP BY stage, model, fixed
    """
)
def request_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events")

    def choose(names: list[str], place):
        return F.element_at(F.array(*(F.lit(n) for n in names)), (place + 1).cast("int"))

    calls = events.select(
        choose(_STAGES, F.col("event_id") % 6).alias("stage"),
        choose(_MODELS, F.col("event_id") % 7 % 3).alias("model"),
    )
    full = requests.request_params(calls, F.col("stage"), F.col("model"))
    settings = ["temperature", "max_tokens", "stop", "token_field", "reasoning_effort"]
    return (
        full.withColumn("stop", F.array_join("stop", ","))
        .groupBy("stage", "model", *settings)
        .agg(F.count(F.lit(1)).alias("n_requests"))
    )


# --- responses and resume ----------------------------------------------------

def _event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answered calls: an error event failed, its text tells how."""
    failed = F.col("event_type") == "error"
    code = F.when(F.col("event_id") % 631 == 429, F.lit("HTTP 429")).otherwise(F.lit("HTTP 500"))
    return v.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        m.request_id("call", F.col("event_id")).alias("request_id"),
        F.col("event_type").alias("stage"),
        "value",
        F.when(~failed, F.col("props")).alias("text"),
        F.when(failed, code).alias("error"),
    )


view(
    "answers",
    f"""
    SELECT event_id AS ord, {_request_id('call', 'event_id')} AS request_id, event_type AS stage, value,
      CASE WHEN event_type <> 'error' THEN props END AS text,
      CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 631 = 429 THEN 'HTTP 429' ELSE 'HTTP 500' END END AS error
    FROM events
    """,
)
_STORED = d.digit_sql("stored", "ord")


@query(
    f"SELECT request_id, ord, CASE WHEN {_STORED} < 'c' THEN text END AS text, "
    f"CASE WHEN {_STORED} < 'c' THEN error ELSE 'no response' END AS error FROM answers",
    "answers",
)
def join_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the answers of a store, whose side is not shuffled."""
    calls = _event_answers(spark, sf_dir)
    return model.join_responses(calls.select("request_id", "ord"), _stored_answers(calls).read())


def _stored_answers(calls: DataFrame) -> AnswerStore:
    store = AnswerStore(calls.sparkSession, f"{stages.shared_folder(calls.sparkSession)}/answers")
    store.append(calls.filter(d.digit("stored", "ord") < "c"))
    return store


@query(
    """
    SELECT id, CASE WHEN contains(text, chr(34)) THEN NULL ELSE replace(text, ' ', '_') || ' 1.0' END AS text,
      CASE WHEN contains(text, chr(34)) THEN 'ValueError: 429 quoted' END AS error
    FROM examples
    """,
    "examples",
)
def apply_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python callable over every document; its exceptions become row errors."""
    asked = v.examples(spark, sf_dir).select(
        F.col("id").alias("request_id"), F.array(m.message("user", F.col("text"))).alias("messages")
    )
    asked = requests.request_params(asked, "semantic", "test-model")

    def make_client():
        def client(messages, temperature, max_tokens, stop):
            text = messages[-1]["content"]
            if '"' in text:
                raise ValueError("429 quoted")
            return f"{text.replace(' ', '_')} {temperature}"

        return client

    answered = model.apply_model(asked, make_client)
    return answered.withColumnRenamed("request_id", "id")


@query(
    f"""
    SELECT request_id, ord, false AS retry FROM answers WHERE {_STORED} >= 'c'
    UNION ALL SELECT request_id, ord, true FROM answers WHERE {_STORED} >= 'c' OR error IS NOT NULL
    """,
    "answers",
)
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store does not answer, without and with its failed calls; its side is not shuffled."""
    calls = _event_answers(spark, sf_dir)
    done = _stored_answers(calls).read()
    asked = calls.select("request_id", "ord")
    first = runcontrol.pending(asked, done).withColumn("retry", F.lit(False))
    again = runcontrol.pending(asked, done, retry_failed=True).withColumn("retry", F.lit(True))
    return first.unionByName(again)


_NEW = d.digit_sql("new", "ord")


@query(
    f"""
    SELECT request_id, coalesce(CASE WHEN {_STORED} < 'c' THEN text END, CASE WHEN {_NEW} < 'c' THEN 'retried ' || ord END) AS text,
      CASE WHEN {_STORED} < 'c' AND text IS NOT NULL OR {_NEW} < 'c' THEN NULL ELSE error END AS error
    FROM answers WHERE {_STORED} < 'c' OR {_NEW} < 'c'
    """,
    "answers",
)
def resume_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers merged with those of a second run, through the progress table."""
    root = stages.shared_folder(spark)
    calls = _event_answers(spark, sf_dir)
    done = calls.filter(d.digit("stored", "ord") < "c")
    again = calls.filter(d.digit("new", "ord") < "c").select(
        "request_id",
        F.concat(F.lit("retried "), F.col("ord").cast("string")).alias("text"),
        F.lit(None).cast("string").alias("error"),
    )
    stages.append_results(done, root, "answers", 0)
    stages.append_results(again, root, "answers", 1)
    return stages.read_results(spark, root, "answers")


@query(
    """
    SELECT stage, count(*) AS n_rows, CAST(sum(kept) AS BIGINT) AS n_kept, CAST(sum(flag) AS BIGINT) AS n_default FROM (
      SELECT s.stage, CASE WHEN s.stage IN ('generation', 'semantic', 'discriminator') OR error IS NULL THEN 1 ELSE 0 END AS kept,
        CASE WHEN s.stage IN ('generation', 'semantic', 'discriminator') AND error IS NOT NULL THEN 1 ELSE 0 END AS flag
      FROM answers, (SELECT unnest(['pattern', 'candidates', 'generation', 'semantic', 'discriminator', 'scoring']) AS stage) s)
    GROUP BY stage
    """,
    "answers",
)
def failure_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and rows set to the default verdict, per stage."""
    calls = _event_answers(spark, sf_dir).select(
        "error",
        F.lit("made").alias("counterfactual"),
        F.lit(True).alias("matched_pattern"),
        F.lit(False).alias("is_ori"),
        F.lit(True).alias("is_target"),
    )
    defaults = {
        "generation": F.col("counterfactual") == "",
        "semantic": ~F.col("matched_pattern"),
        "discriminator": F.col("is_ori") & ~F.col("is_target"),
    }
    out = None
    for stage in _STAGES:
        kept = runcontrol.apply_failure_default(calls, stage)
        one = kept.agg(
            F.count(F.lit(1)).alias("n_kept"),
            F.count_if(defaults.get(stage, F.lit(False))).alias("n_default"),
        ).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    total = calls.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.withColumn("n_rows", total)


@query(
    """
    SELECT outcome, count(*) AS n_calls FROM (
      SELECT CASE WHEN error IS NULL THEN 'ok' WHEN contains(error, '429') THEN 'quota' ELSE 'failed' END AS outcome FROM answers)
    GROUP BY outcome
    """,
    "answers",
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runcontrol.error_classes(_event_answers(spark, sf_dir))


@query(
    """
    SELECT ord, text, error FROM (
      SELECT *, min(CASE WHEN streak >= 5 THEN ord END) OVER () AS cut FROM (
        SELECT *, ord - coalesce(max(CASE WHEN error IS NULL THEN ord END) OVER (ORDER BY ord), -1) AS streak FROM (
          SELECT ord, text, CASE WHEN error IS NOT NULL THEN 'failed' END AS error FROM answers)))
    WHERE cut IS NULL OR ord < cut
    """,
    "answers",
)
def failure_streak_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where five failures in a row would have stopped the run."""
    calls = _event_answers(spark, sf_dir).select(
        "ord", "text", F.when(F.col("error").isNotNull(), F.lit("failed")).alias("error")
    )
    return runcontrol.stop_on_failures(calls)


@query(
    """
    SELECT ord, text, error FROM answers
    WHERE ord < (SELECT coalesce(min(ord), 9223372036854775807) FROM answers WHERE contains(error, '429'))
    """,
    "answers",
)
def quota_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quota error would have stopped the run."""
    calls = _event_answers(spark, sf_dir).select("ord", "text", "error")
    return runcontrol.stop_on_failures(calls, max_consecutive=1_000_000)


view(
    "costs",
    r"SELECT ord, label, CAST(floor(len(regexp_extract_all(text, '\S+')) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS tokens FROM examples",
    "examples",
)


@query(
    """
    SELECT ord, tokens, CAST(spent AS BIGINT) AS spent FROM (
      SELECT ord, tokens, coalesce(sum(tokens) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM costs)
    WHERE spent <= 250000
    """,
    "costs",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.examples(spark, sf_dir).select("ord", runcontrol.token_estimate(F.col("text")).alias("tokens"))
    return runcontrol.within_budget(calls, limit=250_000, bucket_rows=256)


@query(
    r"""
    SELECT role, count(*) AS n_calls, CAST(sum(floor(len(regexp_extract_all('be brief ' || text || text, '\S+')) * CAST(1.3 AS DOUBLE))) AS BIGINT) AS tokens
    FROM conversations GROUP BY role
    """
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per role when each turn is sent with a system text and repeated as reply."""
    turns = v.table(spark, sf_dir, "conversations").withColumn(
        "messages", F.array(m.message("system", F.lit("be brief")), m.message("user", F.col("text")))
    )
    return runcontrol.token_usage(turns, runcontrol.call_tokens(F.col("messages"), F.col("text")), ["role"])


