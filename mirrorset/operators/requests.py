"""Request tables: one row per model call, with its keys, messages and settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as m
from .labels import mask_labels
from .order import pinned
from .sampling import batch_text, topn_per_id

# Texts up to this length are sent to every executor.
BROADCAST_CHARS = 8_000_000

# A row of the later stages: the example by its place, the matched pair, its phrase and the
# target label. Places are unique where ids may repeat; the id is data.
ROW_KEYS = ("ord", "pair_no", "phrase_no", "target_label")

# What a model step is told besides the messages.
PARAMS = ("temperature", "max_tokens", "stop", "token_field", "reasoning_effort")


def row_order() -> Column:
    """Input order of those rows: example, pair, phrase, then first use of the target."""
    return F.struct("ord", "pair_no", "phrase_no", "target_no")


def request_params(df: DataFrame, stage: str | Column, model: str | Column) -> DataFrame:
    """Temperature, token limit and stop strings of a stage, adjusted to the model.

    Some model families run at temperature 1.0 without stop strings and take
    the token limit under another field name.
    """
    stage_col = stage if isinstance(stage, Column) else F.lit(stage)
    model_col = F.lower(model if isinstance(model, Column) else F.lit(model))
    fixed = F.lit(False)
    for family in m.FIXED_TEMPERATURE_FAMILIES:
        fixed = fixed | model_col.contains(family)

    def by_stage(place: int, cast: str) -> Column:
        out = F.lit(None).cast(cast)
        for name, values in m.STAGE_DEFAULTS.items():
            value = values[place]
            value = F.array(*(F.lit(v) for v in value)) if isinstance(value, list) else F.lit(value)
            out = F.when(stage_col == name, value.cast(cast)).otherwise(out)
        return out

    return df.select(
        "*",
        F.when(fixed, F.lit(1.0)).otherwise(by_stage(0, "double")).alias("temperature"),
        by_stage(1, "int").alias("max_tokens"),
        F.when(~fixed, by_stage(2, "array<string>")).alias("stop"),
        F.when(fixed, F.lit("max_completion_tokens")).otherwise(F.lit("max_tokens")).alias("token_field"),
        F.when(fixed, F.lit("low")).alias("reasoning_effort"),
    )


def content_ids(asked: DataFrame) -> DataFrame:
    """Request ids that also depend on what is asked: messages (or context and query) and settings.

    A request with another text, prompt, context or setting is another request, so
    stored answers are never taken for it. Contexts and queries count by their digests, which
    are taken once and not once a request.
    """
    query = "query_id" if "query_id" in asked.columns else "query"
    said = ["messages"] if "messages" in asked.columns else ["context_id", query]
    settings = [c for c in PARAMS if c in asked.columns]
    content = F.md5(F.to_json(F.struct(*said, *settings)))
    return asked.withColumn("request_id", F.md5(F.concat_ws(":", "request_id", content)))


def pattern_requests(batches: DataFrame) -> DataFrame:
    """One request per batch of ``collect_batches``; the batch rides along in ``rows``."""
    return batches.select(
        m.request_id("pattern", F.col("label"), F.col("batch_no")).alias("request_id"),
        "label",
        "batch_no",
        "rows",
        m.pattern_messages(F.col("label"), batch_text(F.col("rows"))).alias("messages"),
    )


def candidate_requests(fan_out: DataFrame) -> DataFrame:
    """One request per (example, phrase, target label)."""
    return fan_out.select(
        m.request_id("candidates", *(F.col(k) for k in ROW_KEYS)).alias("request_id"),
        *fan_out.columns,
        m.candidate_messages(
            F.col("ori_text"), F.col("matched_phrase"), F.col("ori_label"), F.col("target_label")
        ).alias("messages"),
    )


def generation_requests(candidates: DataFrame) -> DataFrame:
    """One request per candidate row."""
    return candidates.select(
        m.request_id("generation", *(F.col(k) for k in ROW_KEYS)).alias("request_id"),
        *candidates.columns,
        m.generation_messages(
            F.col("ori_text"), F.col("ori_label"), F.col("target_label"), F.col("candidate_phrases")
        ).alias("messages"),
    )


def semantic_requests(counterfactuals: DataFrame) -> DataFrame:
    """Requests of the semantic gate, for rows the rule gate let through."""
    return counterfactuals.filter("heuristic_filtered").select(
        m.request_id("semantic", *(F.col(k) for k in ROW_KEYS)).alias("request_id"),
        "id",
        *ROW_KEYS,
        m.semantic_messages(
            F.col("ori_text"), F.col("matched_phrase"), F.col("candidate_phrases"), F.col("counterfactual")
        ).alias("messages"),
    )


def discriminator_requests(gated: DataFrame) -> DataFrame:
    """Requests of the label gate, for rows both earlier gates let through."""
    return gated.filter("heuristic_filtered AND matched_pattern").select(
        m.request_id("discriminator", *(F.col(k) for k in ROW_KEYS)).alias("request_id"),
        "id",
        *ROW_KEYS,
        m.discriminator_messages(
            F.col("counterfactual"), F.col("ori_label"), F.col("target_label")
        ).alias("messages"),
    )


def attach_counterfactuals(
    shots: DataFrame, accepted: DataFrame, max_counterfactuals: int = 4
) -> DataFrame:
    """Chosen examples with their first accepted counterfactuals, as labelled rows.

    One row per (seed, shots, rank, sub); ``sub`` 0 is the example itself. The
    accepted rows are first cut to the chosen ids, a set no larger than the
    largest shot size per seed.
    """
    chosen = pinned(shots.select("id").distinct())
    few = topn_per_id(accepted.join(chosen, "id", "left_semi"), max_counterfactuals).select(
        "id", "sub", F.col("counterfactual").alias("text"), F.col("target_label").alias("label")
    )
    place = shots.select("seed", "shots", "rn", "id")
    originals = shots.select(
        "seed", "shots", "rn", F.lit(0).alias("sub"), F.col("ori_text").alias("text"), F.col("ori_label").alias("label")
    )
    return originals.unionByName(place.join(few, "id").drop("id"))


def few_shot_context(examples: DataFrame, lookup: DataFrame) -> DataFrame:
    """One message list per (seed, shots): system text, then user/assistant pairs.

    ``examples`` are the rows of :func:`attach_counterfactuals`, at most
    ``shots * (1 + max_counterfactuals)`` per list.
    """
    masked = mask_labels(examples, lookup, {"label": "masked"})
    turn = F.struct("rn", "sub", "text", "masked")
    in_order = F.array_sort(F.collect_list(F.struct("label", "masked")))
    names = lookup.agg(F.transform(in_order, lambda r: r["masked"]).alias("names"))
    turns = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(turn)),
            lambda t: F.array(m.message("user", t["text"]), m.message("assistant", t["masked"])),
        )
    )
    system = m.scoring_system(names.scalar())
    return masked.groupBy("seed", "shots").agg(
        turns.alias("_turns"), F.count(F.lit(1)).alias("n_examples")
    ).select(
        "seed",
        "shots",
        F.concat(F.array(system), F.col("_turns")).alias("messages"),
        "n_examples",
    )


def scoring_requests(
    test: DataFrame, shots: Sequence[int], seeds: Sequence[int] = (42,)
) -> DataFrame:
    """Every test row with every seed and shot size, by key.

    The context itself is not copied into each row: the model step gets the few
    contexts beside the requests. :func:`attach_context` makes whole messages where
    a table of them is wanted.
    """
    every_seed = F.explode(F.array(*(F.lit(s) for s in seeds)))
    every_size = F.explode(F.array(*(F.lit(s) for s in shots)))
    paired = test.select(
        F.col("id").alias("test_id"), "ord", F.col("text").alias("query"), "label", F.md5("text").alias("query_id")
    ).withColumn("seed", every_seed).withColumn("shots", every_size)
    return paired.select(
        m.request_id("scoring", F.col("seed"), F.col("shots"), F.col("test_id")).alias("request_id"),
        *paired.columns,
    )


def with_context_id(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """The digest of the context that each request is asked with; requests without a context go."""
    digest = F.md5(F.to_json(F.struct("messages"))).alias("context_id")
    return requests.join(pinned(contexts.select("seed", "shots", digest)), ["seed", "shots"])


def context_chars(contexts: DataFrame) -> int:
    """Characters of all contexts together."""
    chars = F.aggregate("messages", F.lit(0).cast("bigint"), lambda n, t: n + F.length(t["content"]))
    return contexts.agg(F.sum(chars)).first()[0] or 0


def attach_context(
    requests: DataFrame, contexts: DataFrame, broadcast_chars: int = BROADCAST_CHARS, rendered: str | None = None
) -> DataFrame:
    """Append the query of each request to the context of its (seed, shots).

    With ``rendered`` that column holds the whole messages as one text (``messages.render``) in their place, and
    ``<rendered>_chars`` its length. A context is then written out and counted once and not again in every request.

    There are few contexts, so few and hot join keys. Contexts whose texts are
    short enough, which is checked, are broadcast. Longer ones are repeated once
    per salt and meet evenly salted requests in a shuffle join.
    """
    keys = ["seed", "shots"]
    contexts = contexts.select(*keys, "messages")
    short = context_chars(contexts) <= broadcast_chars
    if rendered is not None:
        contexts = contexts.select(*keys, m.render(F.col("messages")).alias("_context")).withColumn("_chars", F.length("_context"))
    if short:
        joined = requests.join(F.broadcast(contexts), keys)
    else:
        salts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
        salted = requests.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(salts)))
        copies = contexts.withColumn("_salt", F.explode(every))
        joined = salted.join(copies, [*keys, "_salt"]).drop("_salt")
    query = F.array(m.message("user", F.col("query")))
    if rendered is not None:
        # an empty text on either side has no line of its own
        said, turn = F.col("_context").isNotNull(), m.render(query)
        both = F.concat_ws("\n", F.nullif("_context", F.lit("")), F.nullif(turn, F.lit("")))
        chars = F.col("_chars") + F.length(turn) + F.when((F.col("_chars") > 0) & (turn != ""), 1).otherwise(0)
        return joined.select(
            *(c for c in joined.columns if c not in ("_context", "_chars")),
            F.when(said, both).alias(rendered),
            chars.alias(f"{rendered}_chars"),
        )
    return joined.withColumn("messages", F.concat("messages", query))


def dialect_turns(turns: DataFrame, key: str, ord_col: str, content: str) -> DataFrame:
    """Row form of the dialect change, for conversations of any length.

    Each user or assistant turn carries the last system text of its
    conversation; nothing is collected per conversation.
    """
    system = turns.filter(F.col("role") == "system").groupBy(key).agg(
        F.nullif(F.max_by(content, ord_col), F.lit("")).alias("system")
    )
    kept = turns.filter(F.col("role").isin("user", "assistant"))
    role = F.when(F.col("role") == "assistant", F.lit("model")).otherwise(F.col("role"))
    return kept.join(system, key, "left").select(
        key, ord_col, role.alias("role"), F.col(content).alias("content"), "system"
    )
