"""Scans, sinks, missing values, labels and run keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.functions import text as t
from mirrorset.operators import labels
from mirrorset.operators.gates import rate
from mirrorset.sources import stages
from mirrorset.sources.examples import parse_repr_list, read_examples

from . import doubles as d
from . import views as v
from .registry import query


@query("SELECT id, text, label, ord FROM examples", "examples")
def scan_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_examples(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "lang")


@query("SELECT id, text, label, ord FROM examples", "examples")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as CSV, with quotes and line breaks in fields, written in order and read back."""
    path = f"{stages.shared_folder(spark)}/documents.csv"
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('",'))
    rows = v.examples(spark, sf_dir).select("id", quoted.alias("example"), F.col("label").alias("Label"), "ord")
    ordered = rows.repartitionByRange("ord").sortWithinPartitions("ord").drop("ord")
    ordered.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_examples(spark, path, "id", "example", "Label")
    return back.withColumn("text", F.substring("text", 2, F.length("text") - 3))


@query("SELECT id, text, label, ord FROM examples", "examples")
def stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write two runs of a stage, read one back by its run key."""
    root = stages.shared_folder(spark)
    df = v.examples(spark, sf_dir)
    stages.write_stage(df, root, "examples", 42, "model:7b-chat", "documents.train")
    stages.write_stage(df.withColumn("ord", -F.col("ord")), root, "examples", 1, "model:7b-chat", "documents.train")
    return stages.read_stage(spark, root, "examples", 42, "model:7b-chat", "documents.train")


@query(
    f"""
    SELECT id, array_to_string(phrases, ' | ') AS phrases, len(phrases) AS n_phrases FROM (
      SELECT id, [{d.FIRST_WORD_SQL}, 'it''s ' || {d.LAST_WORD_SQL}, text, 'say "' || {d.FIRST_WORD_SQL} || '", it''s',
        chr(92) || 'x41 ' || chr(8203) || chr(7)] AS phrases FROM examples)
    """,
    "examples",
)
def import_repr_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List text of whole documents and of phrases with quotes of both kinds and codes, parsed back."""
    phrases = F.array(
        d.first_word(F.col("text")),
        F.concat(F.lit("it's "), d.last_word(F.col("text"))),
        F.col("text"),
        F.concat(F.lit('say "'), d.first_word(F.col("text")), F.lit("\", it's")),
        F.lit("\\x41 \u200b\x07"),
    )

    def written_as(p: Column) -> Column:
        for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\x07", "\\x07"), ("\u200b", "\\u200b")):
            p = F.replace(p, F.lit(plain), F.lit(code))
        single = F.concat(F.lit("[['"), F.replace(p, F.lit("'"), F.lit("\\'")), F.lit("']]"))
        return F.when(p.contains("'") & ~p.contains('"'), F.concat(F.lit('[["'), p, F.lit('"]]'))).otherwise(single)

    quoted = F.transform(phrases, written_as)
    written = v.examples(spark, sf_dir).select(
        "id", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("highlight")
    )
    parsed = written.withColumn("phrases", parse_repr_list(F.col("highlight")))
    return parsed.select(
        "id",
        F.array_join("phrases", " | ").alias("phrases"),
        F.size("phrases").cast("bigint").alias("n_phrases"),
    )


_MARKED = f"""
  CASE {d.digit_sql('null', 'id')} WHEN '0' THEN 'None' WHEN '1' THEN 'NULL' WHEN '2' THEN '' WHEN '3' THEN 'nan'
    WHEN '4' THEN 'n/a' WHEN '5' THEN 'NONE' ELSE label END
"""


@query(
    f"""
    SELECT label, count(*) AS n_rows FROM (
      SELECT CASE WHEN lower(label) IN ('none', 'null', '', 'nan') OR label = 'n/a' THEN NULL ELSE label END AS label
      FROM (SELECT {_MARKED} AS label FROM examples))
    GROUP BY label
    """,
    "examples",
)
def null_like_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = d.digit("null", "id")
    marked = F.col("label")
    for digit, token in zip("012345", ["None", "NULL", "", "nan", "n/a", "NONE"]):
        marked = F.when(draw == digit, F.lit(token)).otherwise(marked)
    df = v.examples(spark, sf_dir).select(t.canonical_label(marked).alias("label"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT label, min(ord) AS first_ord FROM examples WHERE label <> 'es' GROUP BY label", "examples")
def label_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_domain(v.examples(spark, sf_dir), ["es"])


@query(
    """
    SELECT label, 'concept ' || chr(CAST(64 + row_number() OVER (ORDER BY label) AS INTEGER)) AS masked FROM (
      SELECT DISTINCT ori_label AS label FROM filtered UNION SELECT DISTINCT target_label FROM filtered)
    """,
    "filtered",
)
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_map(labels.all_labels(v.filtered(spark, sf_dir)))


@query(
    """
    SELECT label, 'concept ' || CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + i // 26 - 1) || chr(65 + i % 26)
      ELSE chr(65 + (i // 26 - 1) // 26 - 1) || chr(65 + (i // 26 - 1) % 26) || chr(65 + i % 26) END AS masked
    FROM (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS i
      FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS label FROM lineitem))
    """
)
def label_names_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for as many labels as there are parts."""
    named = v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("label"))
    return labels.label_map(labels.all_labels(named, columns=["label"]))


@query(
    """
    SELECT id, target_label, phrase_no, o.masked AS masked_ori, g.masked AS masked_target FROM fan_out
    JOIN label_map o ON o.label = ori_label JOIN label_map g ON g.label = target_label
    WHERE ori_label <> 'es' AND target_label <> 'es'
    """,
    "fan_out label_map",
)
def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked label pairs; rows with a label outside the map are dropped."""
    lookup = v.label_map(spark, sf_dir).filter(F.col("label") != "es")
    masked = labels.mask_labels(
        v.fan_out(spark, sf_dir), lookup, {"ori_label": "masked_ori", "target_label": "masked_target"}
    )
    return masked.select("id", "target_label", "phrase_no", "masked_ori", "masked_target")


@query("SELECT ori_label, count(*) AS n_rows FROM fan_out WHERE ori_label = 'es' GROUP BY ori_label", "fan_out")
def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = v.label_map(spark, sf_dir).filter(F.col("label") != "es")
    return labels.unmapped_labels(v.fan_out(spark, sf_dir), lookup, "ori_label")


@query(
    """
    SELECT seed, shots, test_id, y_pred, label AS label_pred FROM predictions
    LEFT JOIN label_map ON masked = y_pred
    """,
    "predictions",
)
def unmask_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.unmask(v.predictions(spark, sf_dir), v.label_map(spark, sf_dir))
    return out.select("seed", "shots", "test_id", "y_pred", "label_pred")


@query("SELECT id, label, CAST(length(text) AS INTEGER) AS n_chars FROM examples WHERE label <> 'es'", "examples")
def eval_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = v.label_map(spark, sf_dir, ("es",))
    known = labels.known_labels(v.examples(spark, sf_dir), lookup)
    return known.select("id", "label", F.length("text").alias("n_chars"))


@query(
    """
    SELECT id, phrase_no, target_label, matched_phrase, target_no, CAST(length(ori_text) AS INTEGER) AS n_chars FROM fan_out
    """,
    "fan_out",
)
def fan_out_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.fan_out(spark, sf_dir).select(
        "id", "phrase_no", "target_label", "matched_phrase", "target_no", F.length("ori_text").alias("n_chars")
    )


@query(
    r"""
    SELECT source, regexp_replace(source || ':' || lang || '-v1.0/x', '[:/.\-]', '_', 'g') AS slug, count(*) AS n_rows
    FROM documents GROUP BY source, lang
    """
)
def run_key_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit(":"), "lang", F.lit("-v1.0/x"))
    return docs.groupBy("source", t.slug(name).alias("slug")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """
    SELECT label, count(*) AS n_rows, CAST(sum(ok) AS BIGINT) AS n_ok, sum(ok) / count(*) AS ok_rate FROM (
      SELECT label, CAST(NOT (contains(lower(text), 'the ') AND contains(lower(text), 'and ')) AS INTEGER) AS ok FROM examples)
    GROUP BY label
    """,
    "examples",
)
def heuristic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule gate with two phrases that occur in the corpus, and its pass rate per label."""
    ok = t.heuristic_ok(F.col("text"), ("the ", "and "))
    counts = v.examples(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_ok")
    )
    return counts.withColumn("ok_rate", rate(F.col("n_ok"), F.col("n_rows")))
