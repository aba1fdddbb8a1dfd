"""Gates, export, augmentation and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.operators import evaluation, gates, labels
from mirrorset.plans import augmentation, scoring
from mirrorset.plans.run import Run
from mirrorset.sources import stages

from . import doubles as d
from . import views as v
from .registry import query


@query(
    "SELECT id, phrase_no, target_label, heuristic_filtered, matched_pattern, is_ori, is_target FROM filtered",
    "filtered",
)
def staged_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.filtered(spark, sf_dir).select(
        "id", "phrase_no", "target_label", "heuristic_filtered", "matched_pattern", "is_ori", "is_target"
    )


@query(
    f"""
    SELECT id, ori_text, ori_label, pattern, counterfactual AS counter_text, target_label AS counter_label
    FROM filtered WHERE {v.ACCEPTED_SQL}
    """,
    "filtered",
)
def fine_tune_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.export_fine_tune(v.filtered(spark, sf_dir))


@query(
    f"""
    SELECT id, ori_text, ori_label, pattern, counterfactual AS counter_text, target_label AS counter_label
    FROM run_filtered WHERE {v.ACCEPTED_SQL}
    """,
    "run_filtered",
)
def augment_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over every sentence: batches, patterns, candidates, rewrites, gates, export."""
    run = Run(spark, stages.shared_folder(spark), "double", "documents", v.respond, v.SEED)
    return augmentation.augment(run, v.sentences(spark, sf_dir), None, token_limit=None)


@query(
    f"""
    SELECT origin, label, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT id) AS n_ids FROM (
      SELECT id, text, label, 'original' AS origin FROM examples
      UNION ALL SELECT id, counterfactual, target_label, 'counterfactual' FROM filtered WHERE {v.ACCEPTED_SQL})
    GROUP BY origin, label
    """,
    "examples filtered",
)
def augmented_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = gates.augment(v.examples(spark, sf_dir), fine_tune_export(spark, sf_dir))
    return both.groupBy("origin", "label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length("text")).alias("n_chars"),
        F.count_distinct("id").alias("n_ids"),
    )


@query(
    """
    SELECT ori_label, target_label, verdict, count(*) AS n_rows FROM (
      SELECT *, CASE WHEN NOT is_ori AND is_target THEN 'pass' WHEN NOT is_ori OR is_target THEN 'partial'
        WHEN is_ori IS NOT NULL THEN 'fail' END AS verdict FROM filtered)
    GROUP BY ori_label, target_label, verdict
    """,
    "filtered",
)
def verdict_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.filtered(spark, sf_dir)
    return rows.groupBy("ori_label", "target_label", gates.verdict().alias("verdict")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    """
    SELECT ori_label, count(*) AS n_rows, CAST(count_if(heuristic_filtered) AS BIGINT) AS n_heuristic, CAST(count_if(matched_pattern) AS BIGINT) AS n_matched,
      round(count_if(heuristic_filtered) / count(*), 6) AS heuristic_rate,
      round(CASE WHEN count_if(heuristic_filtered) > 0 THEN count_if(matched_pattern) / count_if(heuristic_filtered) ELSE 0 END, 6) AS matched_rate
    FROM filtered GROUP BY ori_label
    """,
    "filtered",
)
def gate_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rounded(gates.pass_rates(v.filtered(spark, sf_dir), ["ori_label"]))


@query(
    """
    SELECT *, round(CASE WHEN n_reached > 0 THEN n_not_ori / n_reached ELSE 0 END, 6) AS not_ori_rate,
      round(CASE WHEN n_reached > 0 THEN n_target / n_reached ELSE 0 END, 6) AS target_rate
    FROM (SELECT target_label, CAST(count_if(heuristic_filtered AND matched_pattern) AS BIGINT) AS n_reached, CAST(count_if(NOT is_ori) AS BIGINT) AS n_not_ori,
      CAST(count_if(is_target) AS BIGINT) AS n_target, CAST(count_if(NOT is_ori AND is_target) AS BIGINT) AS n_both FROM filtered GROUP BY target_label)
    """,
    "filtered",
)
def discriminator_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rounded(gates.discriminator_rates(v.filtered(spark, sf_dir), ["target_label"]))


@query(
    f"""
    SELECT id, ori_text, ori_label, pattern, counterfactual AS counter_text, target_label AS counter_label
    FROM run_filtered WHERE {v.ACCEPTED_SQL}
    """,
    "run_filtered",
)
def rerun_changed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over other texts of the same ids, then one over the sentences in the same folder."""
    run = Run(spark, stages.shared_folder(spark), "double", "documents", v.respond, v.SEED)
    rows = v.sentences(spark, sf_dir)
    augmentation.augment(run, rows.withColumn("text", F.concat(F.lit("so "), F.col("text"))), None)
    return augmentation.augment(run, rows, None)


@query(
    "SELECT id, phrase_no, target_label, counterfactual, error IS NOT NULL AS failed FROM counterfactuals",
    "counterfactuals",
)
def generate_stop_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation that stops at a quota error, goes on in a second run, and ends in a third."""
    root, asked = stages.shared_folder(spark), v.staged(v.candidates(spark, sf_dir), "candidates")
    high = asked.agg(F.max("ord")).first()[0]

    def until(last: int):
        def respond(requests: DataFrame, stage: str) -> DataFrame:
            # calls past a place fail by quota; the others by their double
            rows = requests.select("request_id", F.col("ord") > last)
            spent = rows.toDF("request_id", "_spent")
            quota = F.when(F.col("_spent"), F.lit("Error 429: quota exceeded"))
            said = v.respond(requests, stage).join(spent, "request_id")
            return said.select("request_id", F.when(~F.col("_spent"), F.col("text")).alias("text"), F.coalesce(quota, "error").alias("error"))

        return respond

    for attempt, last in enumerate((high // 3, 2 * high // 3, high)):
        run = Run(spark, root, "double", "documents", until(last), v.SEED, attempt)
        made = augmentation.generate(run, asked, max_consecutive=1_000_000)
    return made.select("id", "phrase_no", "target_label", "counterfactual", F.col("error").isNotNull().alias("failed"))


_SAVED = d.digit_sql("saved", "id", "phrase_no", "target_label")


@query(
    f"""
    SELECT id, phrase_no, target_label, CASE WHEN {_SAVED} < '8' THEN is_ori END AS is_ori,
      CASE WHEN {_SAVED} < '8' THEN is_target END AS is_target FROM filtered
    """,
    "filtered",
)
def overlay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved verdicts of a run that was cut short, laid over the whole table by key."""
    keys = ["id", "phrase_no", "target_label"]
    rows = v.filtered(spark, sf_dir)
    saved = rows.filter(d.digit("saved", *keys) < "8")
    bare = v.counterfactuals(spark, sf_dir).select(*keys, F.lit(None).cast("boolean").alias("is_ori"))
    return gates.overlay(bare, saved, ["is_ori", "is_target"], keys)


_METRIC_COLUMNS = "seed, shots, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fscore, 6) AS fscore, round(accuracy, 6) AS accuracy, test_size"


@query(f"SELECT {_METRIC_COLUMNS} FROM metrics", "metrics")
def metrics_by_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rounded(v.metrics(spark, sf_dir))


@query(f"SELECT {_METRIC_COLUMNS} FROM metrics", "metrics")
def rescore_changed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scoring run with shorter contexts and useless answers, then the real one in the same folder."""
    lookup = v.label_map(spark, sf_dir)

    def useless(requests: DataFrame, stage: str, contexts: DataFrame) -> DataFrame:
        return requests.select("request_id", F.lit("none").alias("text"), F.lit(None).cast("string").alias("error"))

    def real(requests: DataFrame, stage: str, contexts: DataFrame) -> DataFrame:
        truth = labels.mask_labels(requests, lookup, {"label": "masked"})
        draw = d.digit("pred", "seed", "shots", "test_id")
        said = truth.select("request_id", d.prediction_reply(draw, F.col("masked")).alias("text"))
        return said.withColumn("error", d.failure(F.col("text")))

    root, rows = stages.shared_folder(spark), v.staged(v.filtered(spark, sf_dir), "filtered")
    for respond, most in ((useless, 1), (real, 4)):
        run = Run(spark, root, "double", "documents", respond, v.SEED)
        out = scoring.score(run, rows, v.examples(spark, sf_dir), v.SHOTS, v.SEEDS, max_counterfactuals=most)
    return v.rounded(out)


@query(
    "SELECT seed, shots, y_true, y_pred, count(*) AS n FROM predictions GROUP BY seed, shots, y_true, y_pred",
    "predictions",
)
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(v.predictions(spark, sf_dir))


@query(
    """
    SELECT seed, shots, count(*) AS n, CAST(count_if(y_pred NOT IN (SELECT masked FROM label_map)) AS BIGINT) AS n_unknown
    FROM predictions GROUP BY seed, shots
    """,
    "predictions",
)
def out_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.out_of_domain(v.predictions(spark, sf_dir), v.label_map(spark, sf_dir))


@query(
    f"SELECT {_METRIC_COLUMNS} FROM metrics m WHERE shots = (SELECT max(shots) FROM metrics x WHERE x.seed = m.seed)",
    "metrics",
)
def final_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rounded(evaluation.final_metrics(v.metrics(spark, sf_dir)))


_SUMMARY = ", ".join(
    f"round(avg({s}), 6) AS {s}_mean, round(stddev_pop({s}), 6) AS {s}_std"
    for s in ("precision", "recall", "fscore", "accuracy")
)


@query(f"SELECT shots, count(*) AS n_seeds, {_SUMMARY} FROM metrics GROUP BY shots", "metrics")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rounded(evaluation.seed_summary(v.metrics(spark, sf_dir)))


@query(
    f"SELECT count(*) AS n_seeds, {_SUMMARY} FROM metrics m WHERE shots = (SELECT max(shots) FROM metrics x WHERE x.seed = m.seed)",
    "metrics",
)
def final_seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over seeds of the largest shot size each."""
    final = evaluation.final_metrics(v.metrics(spark, sf_dir))
    return v.rounded(evaluation.seed_summary(final, []))


_PREFIXES = v.counts_sql(
    """(SELECT c.seed, c.shots, c.ord + 1 AS checkpoint, p.y_true, p.y_pred FROM predictions c
        JOIN predictions p ON p.seed = c.seed AND p.shots = c.shots AND p.ord <= c.ord WHERE (c.ord + 1) % 25 = 0)""",
    "seed, shots, checkpoint",
)


@query(
    "SELECT seed, shots, checkpoint, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(fscore, 6) AS fscore, round(accuracy, 6) AS accuracy, test_size FROM ("
    + v.macro_sql(f"({_PREFIXES})", "seed, shots, checkpoint")
    + ")",
    "predictions",
)
def prefix_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rounded(evaluation.prefix_metrics(v.predictions(spark, sf_dir), 25, bucket_rows=16))
