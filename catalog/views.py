"""Roles of the given tables, as DataFrames and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.functions import messages as m
from mirrorset.functions.text import clean_generated
from mirrorset.operators import gates, labels, requests
from mirrorset.operators.evaluation import macro_prf
from mirrorset.operators.order import spread
from mirrorset.operators.runcontrol import apply_failure_default
from mirrorset.plans import augmentation, scoring
from mirrorset.sources import stages

from . import doubles as d
from .registry import view

SEED = 42
SEEDS = (1, 42)
SHOTS = (10, 15, 30)
WS = "chr(32) || chr(9) || chr(10) || chr(13)"
QUOTE_CHARS = "chr(34) || chr(39)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def staged(df: DataFrame, stage: str) -> DataFrame:
    """Write a stage and read it back, as every model step does."""
    spark, run = df.sparkSession, (SEED, "double", "documents")
    root = stages.shared_folder(spark)
    stages.write_stage(df, root, stage, *run)
    return stages.read_stage(spark, root, stage, *run)


# --- labelled examples -------------------------------------------------------

def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (id, text, label, ord), whole texts."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("label"), F.col("doc_id").alias("ord")
    )


_ID_SQL = "CAST(doc_id AS VARCHAR) AS id"
view("examples", f"SELECT {_ID_SQL}, text, lang AS label, doc_id AS ord FROM documents")


def with_repeated_ids(sql: str, ids: int) -> str:
    """A query's SQL over examples that share ``ids`` ids."""
    return sql.replace(_ID_SQL, f"CAST(doc_id % {ids} AS VARCHAR) AS id")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with each text on one line, as a reply would repeat it."""
    return examples(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))


view("sentences", "SELECT id, replace(text, chr(10), ' ') AS text, label, ord FROM examples", "examples")

view(
    "batched",
    f"""
    SELECT *, (rn - 1) // 20 AS batch_no, (rn - 1) % 20 AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '{SEED}', id)), id, ord) AS rn
      FROM sentences)
    """,
    "sentences",
)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences in batches of 20 per label."""
    return augmentation.build_batches(sentences(spark, sf_dir), None, SEED)


# --- replies to pattern requests ---------------------------------------------

def pattern_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with a reply each; the replies of failed calls are missing."""
    reply = d.pattern_reply(F.col("rows"), F.col("label"), F.col("batch_no"))
    failed = d.digit("call", "label", "batch_no") == "f"
    return batches(spark, sf_dir).select(
        "*",
        F.when(~failed, reply).alias("text"),
        F.when(failed, F.lit("timeout")).alias("error"),
    )


view(
    "said",
    f"""
    SELECT label, batch_no, pos, {d.SAID_SQL} AS said, array_to_string({d.WORDS_SQL}, ', ') AS words
    FROM (SELECT *, {d.digit_sql('say', 'id')} AS d FROM batched)
    """,
    "batched",
)


def _joined(line: str) -> str:
    return f"string_agg({line}, chr(10) ORDER BY pos)"


view(
    "replies",
    f"""
    SELECT label, batch_no,
      CASE WHEN d < '4' THEN structured
           WHEN d < '6' THEN '```' || chr(10) || structured || chr(10) || '```'
           WHEN d < '9' THEN natural_form
           WHEN d < 'c' THEN bullet
           WHEN d < 'e' THEN spread
           ELSE 'I cannot help with that.' END AS reply
    FROM (
      SELECT label, batch_no, {d.digit_sql('format', 'label', 'batch_no')} AS d,
        {_joined("'SENTENCE: ' || said || chr(10) || 'PHRASES: ' || words || chr(10) || '---'")} AS structured,
        {_joined("'1. Sentence: ' || said || ' Phrases: ' || words")} AS natural_form,
        {_joined("'* ' || said || ' : ' || words")} AS bullet,
        {_joined("'SENTENCE:' || chr(10) || said || chr(10) || 'PHRASES:' || chr(10) || words")} AS spread
      FROM said GROUP BY label, batch_no)
    WHERE {d.digit_sql('call', 'label', 'batch_no')} <> 'f'
    """,
    "said",
)


def clean_sql(text: str) -> str:
    """The fence rule over an already stripped text."""
    lines = f"string_split({text}, chr(10))"
    inner = f"array_to_string(list_slice({lines}, 2, len({lines}) - 1), chr(10))"
    body = f"CASE WHEN len({lines}) > 2 THEN {inner} ELSE {text} END"
    return f"CASE WHEN starts_with({text}, '```') THEN trim(replace({body}, '```', ''), {WS}) ELSE {text} END"


view(
    "cleaned",
    f"SELECT label, batch_no, {clean_sql('t')} AS reply FROM (SELECT label, batch_no, trim(reply, {WS}) AS t FROM replies)",
    "replies",
)


# SQL of the parsers: each view holds (key, strategy, n, sentence, phrases) rows of
# `cleaned`, numbered in the order the parser finds them.

def strip_list(items: str) -> str:
    return (
        f"list_filter(list_transform({items}, lambda p: trim(p, {WS})), lambda p: p <> '')"
    )


def _last(tag: str) -> str:
    hits = f"list_filter(lines, lambda l: starts_with(l, '{tag}'))"
    return f"trim(substr({hits}[-1], {len(tag) + 1}), {WS})"


view(
    "structured",
    f"""
    SELECT label, batch_no, n, sentence, phrases FROM (
      SELECT label, batch_no, n, {_last('SENTENCE:')} AS sentence,
        {strip_list(f"string_split({_last('PHRASES:')}, ',')")} AS phrases
      FROM (
        SELECT label, batch_no, n, list_transform(string_split(section, chr(10)), lambda l: trim(l, {WS})) AS lines
        FROM (SELECT label, batch_no, unnest(string_split(reply, '---')) AS section,
                generate_subscripts(string_split(reply, '---'), 1) AS n FROM cleaned)))
    WHERE sentence <> '' AND len(phrases) > 0
    """,
    "cleaned",
)

# The three loose spellings.
NATURAL_SQL = [
    r"""(?im)(?:(?:\d+\.?\s*)?(?:sentence|text):\s*["']*([^"'\n]+)["']*.*?(?:phrases?|words?|terms?):\s*([^\n]+))""",
    r"""(?im)(?:(?:\d+\.?\s*)?["']*([^"'\n]+)["']*.*?(?:key phrases?|phrases?|words?):\s*([^\n]+))""",
    r"""(?im)(?:(?:\d+\.?\s*)?)["']*([^"'\n,]+)["']*\s*[-–—]\s*([^\n]+)""",
]


def natural_sql(source: str, key: str) -> str:
    parts = []
    for place, pattern in enumerate(NATURAL_SQL):
        quoted = pattern.replace("'", "''")
        first, second = (f"regexp_extract_all(reply, '{quoted}', {g})" for g in (1, 2))
        parts.append(
            f"SELECT {key}, {place} AS place, generate_subscripts({first}, 1) AS i, "
            f"unnest({first}) AS s, unnest({second}) AS p FROM {source}"
        )
    return f"""
      SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY place, i) AS n, sentence, phrases FROM (
        SELECT {key}, place, i, trim(s, {WS}) AS sentence,
          {strip_list("string_split(replace(p, ';', ','), ',')")} AS phrases
        FROM ({' UNION ALL '.join(parts)}))
      WHERE sentence <> '' AND len(phrases) > 0
    """


view("natural_pairs", natural_sql("cleaned", "label, batch_no"), "cleaned")

view(
    "bullets",
    f"""
    SELECT label, batch_no, n, sentence, phrases FROM (
      SELECT label, batch_no, n, sentence, CASE WHEN contains(line, ':')
          THEN {strip_list("string_split(replace(split_part(line, ':', -1), ';', ','), ',')")} ELSE [] END AS phrases
      FROM (
        SELECT l.label, l.batch_no, l.n, l.line, b.text AS sentence,
          row_number() OVER (PARTITION BY l.label, l.batch_no, l.n ORDER BY b.pos) AS hit
        FROM (
          SELECT label, batch_no, n, trim(x, {WS}) AS line FROM (
            SELECT label, batch_no, unnest(string_split(reply, chr(10))) AS x,
              generate_subscripts(string_split(reply, chr(10)), 1) AS n FROM cleaned)
          WHERE trim(x, {WS}) <> '') l
        JOIN batched b ON b.label = l.label AND b.batch_no = l.batch_no
          AND (contains(lower(l.line), lower(b.text)) OR contains(lower(b.text), lower(l.line))))
      WHERE hit = 1)
    WHERE len(phrases) > 0
    """,
    "cleaned batched",
)


def fallback_sql(source: str, key: str) -> str:
    first = r"regexp_extract_all(reply, 'SENTENCE:\s*(.+)', 1)"
    second = r"regexp_extract_all(reply, 'PHRASES:\s*(.+)', 1)"
    return f"""
      SELECT {key}, n, sentence, phrases FROM (
        SELECT {key}, n, trim(s, {WS}) AS sentence, {strip_list("string_split(p, ',')")} AS phrases
        FROM (SELECT {key}, generate_subscripts({first}, 1) AS n, unnest({first}) AS s, unnest({second}) AS p FROM {source}))
      WHERE sentence <> '' AND len(phrases) > 0
    """


view("zipped", fallback_sql("cleaned", "label, batch_no"), "cleaned")

_STRATEGIES = [("structured", "structured"), ("natural", "natural_pairs"), ("bullet", "bullets"), ("fallback", "zipped")]
view(
    "strategies",
    "SELECT c.label, c.batch_no, CASE "
    + " ".join(
        f"WHEN EXISTS (SELECT 1 FROM {source} x WHERE x.label = c.label AND x.batch_no = c.batch_no) THEN '{name}'"
        for name, source in _STRATEGIES
    )
    + " ELSE 'none' END AS strategy FROM cleaned c",
    "cleaned structured natural_pairs bullets zipped",
)
view(
    "pairs",
    "SELECT label, batch_no, strategy, sentence, phrases, "
    "row_number() OVER (PARTITION BY label, batch_no ORDER BY n) - 1 AS pair_no FROM ("
    + " UNION ALL ".join(
        f"SELECT s.label, s.batch_no, s.strategy, x.n, x.sentence, x.phrases FROM strategies s "
        f"JOIN {source} x ON x.label = s.label AND x.batch_no = s.batch_no WHERE s.strategy = '{name}'"
        for name, source in _STRATEGIES
    )
    + ")",
    "strategies",
)


def normalize_sql(text: str) -> str:
    body = rf"regexp_replace(trim({text}, {WS}), '^[-•*\d\.]+\s*', '')"
    body = f"trim(replace(replace({body}, '...', ''), '…', ''), {WS})"
    body = f"trim(lower({body}), {WS})"
    body = f"replace(replace({body}, chr(34), ''), chr(39), '')"
    return rf"rtrim(regexp_replace({body}, '\s+', ' ', 'g'), '. ')"


view(
    "matched",
    f"""
    SELECT label, batch_no, strategy, pair_no, phrases, id, ori_text, ord, tier FROM (
      SELECT *, row_number() OVER (PARTITION BY label, batch_no, pair_no ORDER BY tier, pos) AS place FROM (
        SELECT p.label, p.batch_no, p.strategy, p.pair_no, p.phrases, b.id, b.text AS ori_text, b.ord, b.pos,
          CASE WHEN p.sentence = b.text THEN 0
               WHEN p.norm = b.norm OR (length(p.norm) >= 20 AND (starts_with(b.norm, p.norm) OR starts_with(p.norm, b.norm)))
               THEN 1 END AS tier
        FROM (SELECT *, {normalize_sql('sentence')} AS norm FROM pairs) p
        JOIN (SELECT *, {normalize_sql('text')} AS norm FROM batched) b ON b.label = p.label AND b.batch_no = p.batch_no)
      WHERE tier IS NOT NULL)
    WHERE place = 1
    """,
    "pairs batched",
)

# --- from patterns to the filtered table -------------------------------------


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example with its first and last word as key phrases."""
    phrases = d.words(F.col("text"))
    return examples(spark, sf_dir).select(
        "id",
        F.lit(0).alias("pair_no"),
        F.col("text").alias("ori_text"),
        F.col("label").alias("ori_label"),
        phrases.alias("phrases"),
        F.array_join(phrases, ", ").alias("pattern"),
        "ord",
    )


view(
    "patterns",
    f"SELECT id, 0 AS pair_no, text AS ori_text, label AS ori_label, {d.WORDS_SQL} AS phrases, ord FROM examples",
    "examples",
)
view(
    "domain",
    "SELECT label, min(ord) AS first_ord, CAST(row_number() OVER (ORDER BY min(ord)) - 1 AS INTEGER) AS target_no FROM examples GROUP BY label",
    "examples",
)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.fan_out_targets(
        patterns(spark, sf_dir), labels.label_domain(examples(spark, sf_dir))
    )


def _answered(asked: DataFrame, reply, error: str) -> DataFrame:
    """Requests with the reply of a test double, joined through a response table."""
    text = reply(F.col("_d"))
    return asked.withColumn("text", text).withColumn("error", d.failure(F.col("text"), error)).drop("_d")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fan_out(spark, sf_dir).withColumn("_d", d.digit("cand", "id", "phrase_no", "target_label"))
    answered = _answered(asked, lambda x: d.candidate_reply(x, F.col("matched_phrase")), "quota: 429")
    return augmentation.candidate_rows(answered)


def candidates_sql(reply: str) -> str:
    """List parser over a column ``reply``, leaving ``candidate_phrases``."""
    from mirrorset.functions.replies import LEAD_INS

    lead = "CASE " + " ".join(
        f"WHEN starts_with(lower(t0), '{p}') THEN {len(p)}" for p in LEAD_INS
    ) + " ELSE 0 END"
    return f"""
      SELECT * EXCLUDE (t0, n0, t1, t2, sep),
        list_filter(list_transform(string_split(t2, sep),
          lambda p: regexp_replace(trim(trim(p, {WS}), {QUOTE_CHARS}), '\\s+', ' ', 'g')), lambda p: length(p) > 1) AS candidate_phrases
      FROM (SELECT *, CASE WHEN contains(t2, ',') THEN ',' WHEN contains(t2, ';') THEN ';'
              WHEN contains(t2, chr(10)) THEN chr(10) ELSE '|' END AS sep
        FROM (SELECT *, regexp_replace(regexp_replace(t1, '(?m)^\\d+\\.\\s*', '', 'g'), '(?m)^[-•*]\\s*', '', 'g') AS t2
          FROM (SELECT *, CASE WHEN n0 > 0 THEN trim(substr(t0, n0 + 1), {WS}) ELSE t0 END AS t1
            FROM (SELECT *, {lead} AS n0 FROM (SELECT *, trim(reply, {WS}) AS t0 FROM {reply})))))
    """




def counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = candidates(spark, sf_dir).withColumn("_d", d.digit("gen", "id", "phrase_no", "target_label"))
    reply = lambda x: d.generation_reply(x, F.col("candidate_phrases"), F.col("ori_text"))
    made = _answered(asked, reply, "timeout").withColumn("counterfactual", clean_generated(F.col("text")))
    return staged(apply_failure_default(made, "generation").drop("text"), "counterfactuals")




def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactuals with the verdicts of all gates, each gate on what the earlier let through."""
    key = ["id", "phrase_no", "target_label"]
    ruled = gates.heuristic_gate(counterfactuals(spark, sf_dir)).drop("error")
    asked = F.col("heuristic_filtered")
    said = gates.semantic_verdicts(
        ruled.withColumn("text", d.semantic_reply(d.digit("sem", *key))).withColumn(
            "error", d.failure(F.col("text"))
        )
    )
    gated = said.withColumn("matched_pattern", F.when(asked, F.col("matched_pattern"))).drop("text", "error")
    asked = asked & F.col("matched_pattern")
    said = gates.discriminator_verdicts(
        gated.withColumn("text", d.discriminator_reply(d.digit("disc", *key))).withColumn(
            "error", d.failure(F.col("text"))
        )
    )
    return (
        said.withColumn("is_ori", F.when(asked, F.col("is_ori")))
        .withColumn("is_target", F.when(asked, F.col("is_target")))
        .drop("text", "error")
    )


def two_answers_sql(reply: str) -> str:
    words = f"list_filter(string_split(replace(replace(upper(trim({reply}, {WS})), ',', ' '), chr(10), ' '), ' '), lambda w: w <> '')"
    return words




def define_chain(prefix: str, patterns_view: str) -> None:
    """SQL views from pattern rows to the filtered table, named with a prefix."""
    fan, cand, made = f"{prefix}fan_out", f"{prefix}candidates", f"{prefix}counterfactuals"
    ruled, gated = f"{prefix}ruled", f"{prefix}gated"
    view(
        fan,
        f"""
        SELECT p.id, p.pair_no, p.ori_text, p.ori_label, p.pattern, p.ord, p.phrase_no, p.matched_phrase,
          d.label AS target_label, d.target_no
        FROM (SELECT id, pair_no, ori_text, ori_label, array_to_string(phrases, ', ') AS pattern, ord,
                CAST(generate_subscripts(phrases, 1) - 1 AS INTEGER) AS phrase_no, unnest(phrases) AS matched_phrase
              FROM {patterns_view}) p
        JOIN domain d ON d.label <> p.ori_label
        """,
        f"{patterns_view} domain",
    )
    view(
        f"{prefix}candidate_replies",
        f"""
        SELECT * EXCLUDE (d), {d.CANDIDATE_REPLY_SQL} AS reply
        FROM (SELECT *, {d.digit_sql('cand', 'id', 'phrase_no', 'target_label')} AS d FROM {fan})
        """,
        fan,
    )
    view(
        cand,
        f"SELECT * EXCLUDE (reply) FROM ({candidates_sql(f'{prefix}candidate_replies')}) WHERE reply IS NOT NULL",
        f"{prefix}candidate_replies",
    )
    view(
        made,
        f"""
        SELECT * EXCLUDE (d, reply), CASE WHEN reply IS NULL THEN '' ELSE trim(trim(reply, {WS}), {QUOTE_CHARS}) END AS counterfactual,
          CASE WHEN reply IS NULL THEN 'timeout' END AS error
        FROM (SELECT *, {d.GENERATION_REPLY_SQL} AS reply
          FROM (SELECT *, {d.digit_sql('gen', 'id', 'phrase_no', 'target_label')} AS d FROM {cand}))
        """,
        cand,
    )
    view(
        ruled,
        f"""
        SELECT * EXCLUDE (error), counterfactual <> '' AND NOT (contains(lower(counterfactual), 'given the constraints')
          AND contains(lower(counterfactual), 'the assistant')) AS heuristic_filtered FROM {made}
        """,
        made,
    )
    view(
        gated,
        f"""
        SELECT * EXCLUDE (d, reply),
          CASE WHEN heuristic_filtered THEN coalesce(contains(upper(trim(reply, {WS})), 'YES'), false) END AS matched_pattern
        FROM (SELECT *, {d.SEMANTIC_REPLY_SQL} AS reply
          FROM (SELECT *, {d.digit_sql('sem', 'id', 'phrase_no', 'target_label')} AS d FROM {ruled}))
        """,
        ruled,
    )
    reached = "heuristic_filtered AND matched_pattern"
    view(
        f"{prefix}filtered",
        f"""
        SELECT * EXCLUDE (d, reply, words),
          CASE WHEN {reached} THEN CASE WHEN len(words) >= 2 THEN contains(words[1], 'YES') ELSE true END END AS is_ori,
          CASE WHEN {reached} THEN CASE WHEN len(words) >= 2 THEN contains(words[-1], 'YES') ELSE false END END AS is_target
        FROM (SELECT *, {two_answers_sql('reply')} AS words FROM (SELECT *, {d.DISCRIMINATOR_REPLY_SQL} AS reply
          FROM (SELECT *, {d.digit_sql('disc', 'id', 'phrase_no', 'target_label')} AS d FROM {gated})))
        """,
        gated,
    )


define_chain("", "patterns")
view(
    "run_patterns",
    "SELECT id, pair_no, ori_text, label AS ori_label, phrases, ord FROM matched",
    "matched",
)
define_chain("run_", "run_patterns")


def respond(asked: DataFrame, stage: str) -> DataFrame:
    """Model step of a whole run by test doubles."""
    key = ["id", "phrase_no", "target_label"]
    if stage == "pattern":
        failed = d.digit("call", "label", "batch_no") == "f"
        text = F.when(~failed, d.pattern_reply(F.col("rows"), F.col("label"), F.col("batch_no")))
    elif stage == "candidates":
        text = d.candidate_reply(d.digit("cand", *key), F.col("matched_phrase"))
    elif stage == "generation":
        text = d.generation_reply(d.digit("gen", *key), F.col("candidate_phrases"), F.col("ori_text"))
    elif stage == "semantic":
        text = d.semantic_reply(d.digit("sem", *key))
    else:
        text = d.discriminator_reply(d.digit("disc", *key))
    answered = asked.select("request_id", text.alias("text"))
    return answered.withColumn("error", d.failure(F.col("text")))


ACCEPTED_SQL = "heuristic_filtered AND matched_pattern AND NOT is_ori AND is_target"
ROW_ORDER_SQL = "ord, pair_no, phrase_no, target_no"

# --- scoring -----------------------------------------------------------------


def label_map(spark: SparkSession, sf_dir: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    named = examples(spark, sf_dir).select("label")
    return labels.label_map(labels.all_labels(named, exclude, ["label"]))


view(
    "label_map",
    "SELECT label, 'concept ' || chr(CAST(64 + row_number() OVER (ORDER BY label) AS INTEGER)) AS masked FROM (SELECT DISTINCT label FROM examples)",
    "examples",
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for every example, seed and shot size."""
    lookup = label_map(spark, sf_dir)
    asked = requests.scoring_requests(examples(spark, sf_dir), SHOTS, SEEDS)
    draw = d.digit("pred", "seed", "shots", "test_id")
    truth = labels.mask_labels(asked, lookup, {"label": "masked"})
    replied = truth.withColumn("text", d.prediction_reply(draw, F.col("masked")))
    answered = replied.withColumn("error", d.failure(F.col("text"))).drop("masked")
    return scoring.predictions(answered, lookup)


view(
    "predictions",
    f"""
    SELECT seed, shots, test_id, ord, y_true, {d.PREDICTION_REPLY_SQL} AS y_pred FROM (
      SELECT seed, shots, e.id AS test_id, ord, masked AS y_true, {d.digit_sql('pred', 'seed', 'shots', 'e.id')} AS d
      FROM examples e JOIN label_map m ON m.label = e.label,
        (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed), (SELECT unnest([{', '.join(map(str, SHOTS))}]) AS shots))
    WHERE d <> 'f'
    """,
    "examples label_map",
)


def macro_sql(counts: str, keys: str) -> str:
    """Macro scores of a view with (keys, class, tp, truth, pred)."""
    return f"""
      SELECT {keys},
        avg(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END) AS precision,
        avg(CASE WHEN truth > 0 THEN tp / truth ELSE 0 END) AS recall,
        avg(CASE WHEN truth + pred > 0 THEN 2 * tp / (truth + pred) ELSE 0 END) AS fscore,
        sum(tp) / sum(truth) AS accuracy, CAST(sum(truth) AS BIGINT) AS test_size
      FROM {counts} GROUP BY {keys}
    """


def counts_sql(source: str, keys: str) -> str:
    return f"""
      SELECT {keys}, class, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(t) AS DOUBLE) AS truth, CAST(sum(p) AS DOUBLE) AS pred FROM (
        SELECT {keys}, y_true AS class, CAST(y_true = y_pred AS INTEGER) AS tp, 1 AS t, 0 AS p FROM {source}
        UNION ALL SELECT {keys}, y_pred, 0, 0, 1 FROM {source})
      GROUP BY {keys}, class
    """


view("class_counts", counts_sql("predictions", "seed, shots"), "predictions")
view("metrics", macro_sql("class_counts", "seed, shots"), "class_counts")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_prf(predictions(spark, sf_dir))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, for a comparison across engines."""
    return df.select(
        *(F.round(name, places).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes)
    )


def message_hash(df: DataFrame, *keep: str) -> DataFrame:
    """Requests with their messages, or the text ``rendered`` of them, as a hash and a length, which compare alike and stay small."""
    if "rendered" in df.columns:
        return df.select(*keep, F.md5("rendered").alias("messages_md5"), F.col("rendered_chars").alias("n_chars"))
    text = m.render(F.col("messages"))
    return df.select(*keep, F.md5(text).alias("messages_md5"), F.length(text).alias("n_chars"))


