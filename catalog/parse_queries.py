"""Reply parsing and matching over every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.functions import replies as r
from mirrorset.functions import text as t
from mirrorset.operators import matching
from mirrorset.plans import augmentation

from . import doubles as d
from . import views as v
from .registry import query, view


def _reply(spark: SparkSession, sf_dir: str, column: Column) -> DataFrame:
    return v.examples(spark, sf_dir).select("id", column.alias("reply"))


def _fence(draw: Column) -> Column:
    text = F.col("text")
    return (
        F.when(draw < "4", F.concat(F.lit("```json\n"), text, F.lit("\n```\n")))
        .when(draw < "6", F.concat(F.lit("\n```"), text, F.lit("```")))
        .when(draw < "8", F.concat(F.lit("```\n"), text))
        .when(draw < "c", F.concat(F.lit(" \n\t"), text, F.lit(" \n")))
        .otherwise(F.concat(text, F.lit("\n```")))
    )


_FENCE_SQL = f"""
  SELECT id, CASE WHEN d < '4' THEN '```json' || chr(10) || text || chr(10) || '```' || chr(10)
    WHEN d < '6' THEN chr(10) || '```' || text || '```'
    WHEN d < '8' THEN '```' || chr(10) || text
    WHEN d < 'c' THEN ' ' || chr(10) || chr(9) || text || ' ' || chr(10)
    ELSE text || chr(10) || '```' END AS reply
  FROM (SELECT *, {d.digit_sql('fence', 'id')} AS d FROM examples)
"""


@query(
    f"SELECT id, {v.clean_sql('t')} AS reply FROM (SELECT id, trim(reply, {v.WS}) AS t FROM ({_FENCE_SQL}))",
    "examples",
)
def clean_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reply(spark, sf_dir, _fence(d.digit("fence", "id")))
    return df.select("id", t.clean_response(F.col("reply")).alias("reply"))


@query(
    f"SELECT id, {v.normalize_sql('reply')} AS norm FROM ("
    "SELECT id, '- 12. ' || chr(34) || text || '...' || chr(34) || ' . ' AS reply FROM examples)",
    "examples",
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit('- 12. "'), F.col("text"), F.lit('..." . '))
    df = _reply(spark, sf_dir, wrapped)
    return df.select("id", t.normalize_text(F.col("reply")).alias("norm"))


@query(
    f"SELECT id, trim(trim(reply, {v.WS}), {v.QUOTE_CHARS}) AS text FROM ("
    "SELECT id, chr(10) || ' ' || chr(34) || chr(39) || text || chr(34) || '  ' AS reply FROM examples)",
    "examples",
)
def clean_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reply(spark, sf_dir, F.concat(F.lit("\n \"'"), F.col("text"), F.lit('"  ')))
    return df.select("id", t.clean_generated(F.col("reply")).alias("text"))


def _exploded(df: DataFrame, key: str = "id") -> DataFrame:
    pairs = df.select(key, F.posexplode_outer("pairs").alias("pair_no", "_p"))
    return pairs.filter(F.col("pair_no").isNotNull()).select(
        key,
        F.col("pair_no").cast("bigint").alias("pair_no"),
        "_p.sentence",
        F.array_join("_p.phrases", ", ").alias("phrases"),
    )


# One reply per document: each line of the text is a sentence of its own.
_LINES = "string_split(text, chr(10))"
view(
    "structured_replies",
    f"""
    SELECT id, array_to_string(list_transform({_LINES}, lambda l: 'SENTENCE: ' || l || chr(10) || '  PHRASES: ' || l || ' ,' || chr(10) || '---'), chr(10))
      || chr(10) || 'SENTENCE: first' || chr(10) || 'SENTENCE: ' || id || chr(10) || 'PHRASES: a, ,b' || chr(10) || '---' || chr(10) || 'PHRASES: only' AS reply
    FROM examples
    """,
    "examples",
)


def _structured_reply() -> Column:
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda line: F.concat(F.lit("SENTENCE: "), line, F.lit("\n  PHRASES: "), line, F.lit(" ,\n---")),
    )
    tail = F.concat(F.lit("\nSENTENCE: first\nSENTENCE: "), F.col("id"), F.lit("\nPHRASES: a, ,b\n---\nPHRASES: only"))
    return F.concat(F.array_join(lines, "\n"), tail)


@query(
    f"""
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS pair_no, sentence, array_to_string(phrases, ', ') AS phrases FROM (
      SELECT id, n, {v._last('SENTENCE:')} AS sentence, {v.strip_list(f"string_split({v._last('PHRASES:')}, ',')")} AS phrases
      FROM (SELECT id, n, list_transform(string_split(section, chr(10)), lambda l: trim(l, {v.WS})) AS lines
        FROM (SELECT id, unnest(string_split(reply, '---')) AS section,
                generate_subscripts(string_split(reply, '---'), 1) AS n FROM structured_replies)))
    WHERE sentence <> '' AND len(phrases) > 0
    """,
    "structured_replies",
)
def parse_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reply(spark, sf_dir, _structured_reply())
    return _exploded(df.select("id", r.parse_structured(F.col("reply")).alias("pairs")))


view(
    "natural_replies",
    f"""
    SELECT id, '1. Sentence: ' || chr(34) || id || chr(34) || ' Key phrases: ' || id || '; b, c' || chr(10)
      || array_to_string(list_transform({_LINES}, lambda l: l || ' phrases: ' || l), chr(10)) || chr(10)
      || '2. ' || text || ' - ' || id || ' x' || chr(10) || text AS reply
    FROM examples
    """,
    "examples",
)


def _natural_reply() -> Column:
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.concat(line, F.lit(" phrases: "), line))
    return F.concat(
        F.lit('1. Sentence: "'), F.col("id"), F.lit('" Key phrases: '), F.col("id"), F.lit("; b, c\n"),
        F.array_join(lines, "\n"),
        F.lit("\n2. "), F.col("text"), F.lit(" - "), F.col("id"), F.lit(" x\n"), F.col("text"),
    )


@query(
    f"SELECT id, n - 1 AS pair_no, sentence, array_to_string(phrases, ', ') AS phrases FROM ({v.natural_sql('natural_replies', 'id')})",
    "natural_replies",
)
def parse_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _reply(spark, sf_dir, _natural_reply())
    return _exploded(df.select("id", r.parse_natural(F.col("reply")).alias("pairs")))


view(
    "spread_replies",
    f"""
    SELECT id, array_to_string(list_transform({_LINES}, lambda l: '1. SENTENCE:' || chr(10) || l || chr(10) || 'x PHRASES: ' || l || ' ,q'), chr(10))
      || chr(10) || 'SENTENCE: odd one' AS reply FROM examples
    """,
    "examples",
)


@query(
    f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS pair_no, sentence, array_to_string(phrases, ', ') AS phrases "
    f"FROM ({v.fallback_sql('spread_replies', 'id')})",
    "spread_replies",
)
def parse_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda line: F.concat(F.lit("1. SENTENCE:\n"), line, F.lit("\nx PHRASES: "), line, F.lit(" ,q")),
    )
    df = _reply(spark, sf_dir, F.concat(F.array_join(lines, "\n"), F.lit("\nSENTENCE: odd one")))
    return _exploded(df.select("id", r.parse_fallback(F.col("reply")).alias("pairs")))


@query(
    f"""
    SELECT id, phrase_no, target_label, array_to_string(candidate_phrases, ' | ') AS candidate_phrases
    FROM ({v.candidates_sql('candidate_replies')}) WHERE reply IS NOT NULL
    """,
    "candidate_replies",
)
def parse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.candidates(spark, sf_dir).select(
        "id", "phrase_no", "target_label", F.array_join("candidate_phrases", " | ").alias("candidate_phrases")
    )


view("text_lists", "SELECT id, 'Here are ' || chr(10) || text AS reply FROM examples", "examples")


@query(
    f"SELECT id, array_to_string(candidate_phrases, ' | ') AS phrases, len(candidate_phrases) AS n_phrases FROM ({v.candidates_sql('text_lists')})",
    "text_lists",
)
def parse_candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list parser on whole documents, cut at whichever separator they hold."""
    df = _reply(spark, sf_dir, F.concat(F.lit("Here are \n"), F.col("text")))
    parsed = df.select("id", r.parse_candidates(F.col("reply")).alias("p"))
    return parsed.select(
        "id", F.array_join("p", " | ").alias("phrases"), F.size("p").cast("bigint").alias("n_phrases")
    )


_ANSWER_SQL = f"""
  SELECT id, CASE WHEN d < '4' THEN 'NO, ' || text WHEN d < '8' THEN text || ' yes' WHEN d < 'a' THEN 'Yesterday'
    WHEN d < 'd' THEN ' YES,NO ' || chr(10) ELSE text END AS reply
  FROM (SELECT *, {d.digit_sql('answer', 'id')} AS d FROM examples)
"""


@query(
    f"""
    SELECT id, contains(upper(trim(reply, {v.WS})), 'YES') AS is_yes,
      CASE WHEN len(words) >= 2 THEN contains(words[1], 'YES') ELSE true END AS is_ori,
      CASE WHEN len(words) >= 2 THEN contains(words[-1], 'YES') ELSE false END AS is_target
    FROM (SELECT *, {v.two_answers_sql('reply')} AS words FROM ({_ANSWER_SQL}))
    """,
    "examples",
)
def parse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw, text = d.digit("answer", "id"), F.col("text")
    reply = (
        F.when(draw < "4", F.concat(F.lit("NO, "), text))
        .when(draw < "8", F.concat(text, F.lit(" yes")))
        .when(draw < "a", F.lit("Yesterday"))
        .when(draw < "d", F.lit(" YES,NO \n"))
        .otherwise(text)
    )
    df = _reply(spark, sf_dir, reply)
    return df.select(
        "id", r.parse_yes_no(F.col("reply")).alias("is_yes"), r.parse_two_answers(F.col("reply")).alias("_a")
    ).select("id", "is_yes", "_a.is_ori", "_a.is_target")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.parse_pattern_replies(v.pattern_replies(spark, sf_dir))


@query(
    """
    SELECT label, batch_no, row_number() OVER (PARTITION BY label, batch_no ORDER BY n) - 1 AS line_no, sentence,
      array_to_string(phrases, ', ') AS phrases FROM bullets
    """,
    "bullets",
)
def parse_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line matcher on every reply, whatever its format."""
    replies = v.pattern_replies(spark, sf_dir).filter(F.col("error").isNull())
    cleaned = t.clean_response(F.col("text"))
    pairs = replies.select("label", "batch_no", matching.bullet_pairs(cleaned, F.col("rows")).alias("pairs"))
    lines = pairs.select("label", "batch_no", F.posexplode_outer("pairs").alias("line_no", "_p"))
    return lines.filter(F.col("line_no").isNotNull()).select(
        "label",
        "batch_no",
        F.col("line_no").cast("bigint").alias("line_no"),
        "_p.sentence",
        F.array_join("_p.phrases", ", ").alias("phrases"),
    )


@query(
    "SELECT label, batch_no, strategy, pair_no, sentence, array_to_string(phrases, ', ') AS phrases FROM pairs",
    "pairs",
)
def parse_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _matched(spark, sf_dir).select("label", "batch_no", "strategy", F.posexplode_outer("pairs").alias("pair_no", "_p"))
    return df.filter(F.col("pair_no").isNotNull()).select(
        "label", "batch_no", "strategy", F.col("pair_no").cast("bigint").alias("pair_no"),
        "_p.sentence", F.array_join("_p.phrases", ", ").alias("phrases"),
    )


@query(
    """
    SELECT label AS ori_label, batch_no, strategy, pair_no, id, ori_text, array_to_string(phrases, ', ') AS pattern,
      CASE tier WHEN 0 THEN 'exact' ELSE 'loose' END AS match FROM matched
    """,
    "matched",
)
def match_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.match_sentences(_matched(spark, sf_dir))
    return out.select(
        "ori_label", "batch_no", "strategy", F.col("pair_no").cast("bigint").alias("pair_no"),
        "id", "ori_text", "pattern", "match",
    )


@query(
    """
    SELECT label, strategy, count(*) AS n_batches, CAST(sum(n_pairs) AS BIGINT) AS n_pairs,
      CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(n_matched - n_ids) AS BIGINT) AS duplicates
    FROM (SELECT s.label, s.strategy,
            (SELECT count(*) FROM pairs p WHERE p.label = s.label AND p.batch_no = s.batch_no) AS n_pairs,
            (SELECT count(*) FROM matched m WHERE m.label = s.label AND m.batch_no = s.batch_no) AS n_matched,
            (SELECT count(DISTINCT id) FROM matched m WHERE m.label = s.label AND m.batch_no = s.batch_no) AS n_ids
          FROM strategies s)
    GROUP BY label, strategy
    """,
    "pairs matched strategies",
)
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.report_totals(matching.parse_report(_matched(spark, sf_dir)))
