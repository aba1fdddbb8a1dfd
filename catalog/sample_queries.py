"""Shuffles, samples, batches, first rows and shot prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.operators import gates, requests, sampling

from . import views as v
from .registry import query

_KEY = f"md5(concat_ws(':', '{v.SEED}', id))"


@query(f"SELECT id, row_number() OVER (ORDER BY {_KEY}, id) AS rn FROM examples", "examples")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_shuffle(v.examples(spark, sf_dir), v.SEED).select("id", "rn")


@query(
    """
    SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY md5(concat_ws(':', '7', id)), id) AS rn
    FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM lineitem)
    """
)
def shuffle_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global shuffle on a large table, ranked without a single-task window."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    df = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("id"))
    return sampling.seeded_shuffle(df, 7).select("l_orderkey", "l_linenumber", "rn")


@query(
    f"""
    SELECT id, label, text, rn FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, id) AS rn FROM examples)
    WHERE rn <= 50
    """,
    "examples",
)
def sample_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = sampling.sample_per_label(v.examples(spark, sf_dir), 50, v.SEED)
    return sampled.select("id", "label", "text", "rn")


@query(
    """
    SELECT label, batch_no, count(*) AS n_examples, string_agg('- ' || text, chr(10) ORDER BY pos) AS lines
    FROM batched GROUP BY label, batch_no
    """,
    "batched",
)
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.batches(spark, sf_dir).select(
        "label",
        "batch_no",
        F.size("rows").cast("bigint").alias("n_examples"),
        sampling.batch_text(F.col("rows")).alias("lines"),
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
    WHERE rn = 1
    """
)
def first_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    df = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", order.alias("ord")
    )
    return sampling.first_per_id(df, "l_orderkey").drop("ord")


@query(
    f"""
    SELECT id, target_label, phrase_no, counterfactual, sub FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY {v.ROW_ORDER_SQL}) AS INTEGER) AS sub
      FROM filtered WHERE {v.ACCEPTED_SQL})
    WHERE sub <= 2
    """,
    "filtered",
)
def topn_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = v.filtered(spark, sf_dir).filter(gates.accepted()).select(
        "id", "target_label", "phrase_no", "counterfactual", requests.row_order().alias("ord")
    )
    return sampling.topn_per_id(accepted, 2).drop("ord")


def _shots_sql(shots: tuple[int, ...], seeds: tuple[int, ...]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT id, {seed} AS seed, row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', id)), id) AS rn FROM examples"
        for seed in seeds
    )
    sizes = f"(SELECT unnest([{', '.join(map(str, shots))}]) AS shots)"
    return f"""
      SELECT seed, shots, rn, id FROM ({parts}), {sizes}
      WHERE rn <= shots AND shots <= (SELECT count(DISTINCT id) FROM examples)
    """


@query(_shots_sql((10, 15, 30, 120, 900), (1, 42)), "examples")
def shot_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.shot_prefixes(v.examples(spark, sf_dir), (10, 15, 30, 120, 900), (1, 42))
    return out.select("seed", "shots", "rn", "id")


@query(
    """
    SELECT shots, n_examples FROM (SELECT count(DISTINCT id) AS n_examples FROM examples),
      (SELECT unnest([10, 15, 30, 120, 900, 5000]) AS shots)
    WHERE shots <= n_examples
    """,
    "examples",
)
def feasible_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.feasible_shots((10, 15, 30, 120, 900, 5000), v.examples(spark, sf_dir))
