"""Patterns, candidates, rewrites, gates and export, stage by stage.

Each stage is: build requests, ask the model, parse, write. Loops over labels,
phrases and targets are keys of one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.replies import parse_candidates
from ..operators import gates, matching, requests, runcontrol, sampling
from ..operators.labels import fan_out_targets, label_domain
from ..operators.order import dense_order
from .run import Run


def with_labels(examples: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Examples whose label counts: not missing, not excluded."""
    labelled = examples.withColumn("label", t.canonical_label(F.col("label")))
    return labelled.filter(F.col("label").isNotNull() & ~F.col("label").isin(list(exclude)))


def build_batches(examples: DataFrame, per_label: int | None, seed: int, size: int = 20) -> DataFrame:
    sampled = sampling.sample_per_label(examples, per_label, seed)
    return sampling.collect_batches(sampling.assign_batches(sampled, size))


def parse_pattern_replies(answered: DataFrame) -> DataFrame:
    """Replies of pattern requests to matched pairs, still one row per batch."""
    kept = runcontrol.apply_failure_default(answered, "pattern")
    cleaned = kept.withColumn("text", t.clean_response(F.col("text")))
    return matching.match_rows(matching.parse_phrases(cleaned))


def find_patterns(
    run: Run,
    examples: DataFrame,
    per_label: int | None = 50,
    exclude: Sequence[str] = (),
    retry_failed: bool = False,
) -> DataFrame:
    """Pattern rows of ``per_label`` examples of each label (all with None)."""
    batches = run.save(
        build_batches(with_labels(examples, exclude), per_label, run.seed), "batches"
    )
    answered = run.answers(requests.pattern_requests(batches), "pattern", retry_failed)
    return run.save(matching.match_sentences(parse_pattern_replies(answered)), "patterns")


def candidate_rows(answered: DataFrame) -> DataFrame:
    kept = runcontrol.apply_failure_default(answered, "candidates")
    parsed = kept.withColumn("candidate_phrases", parse_candidates(F.col("text")))
    return parsed.drop("request_id", "text", "error")


def find_candidates(
    run: Run,
    patterns: DataFrame,
    examples: DataFrame,
    exclude: Sequence[str] = (),
    token_limit: int | None = None,
    retry_failed: bool = False,
) -> DataFrame:
    """Candidate phrases of every pattern row, phrase and other label.

    With ``token_limit`` examples are asked in order while the prompts and replies of this run cost no more; a
    later run goes on from there. The stage ``budget`` says how many examples were asked and how many are left out.
    """
    labels = run.save(label_domain(examples, exclude), "labels")
    asked = requests.candidate_requests(fan_out_targets(patterns, labels))
    if token_limit is None:
        answered = run.answers(asked, "candidates", retry_failed, example="ord")
    else:
        answered = run.answers_within(asked, "candidates", token_limit, retry_failed=retry_failed)
        run.save(runcontrol.left_out(patterns, answered.select("ord").distinct()), "budget")
    return run.save(candidate_rows(answered), "candidates")


def counterfactual_rows(answered: DataFrame) -> DataFrame:
    made = answered.withColumn("counterfactual", t.clean_generated(F.col("text")))
    stored = runcontrol.apply_failure_default(made, "generation")
    return stored.drop("request_id", "text")


def generate(
    run: Run, candidates: DataFrame, max_consecutive: int | None = None, retry_failed: bool = False
) -> DataFrame:
    """One rewrite per candidate row.

    With ``max_consecutive`` the stage ends where a caller working in input order stops: at that many
    failures in a row, or at a quota error. A later run goes on from there.
    """
    if max_consecutive is None:
        answered = run.answers(requests.generation_requests(candidates), "generation", retry_failed, example="ord")
        return run.save(counterfactual_rows(answered), "counterfactuals")
    # placed before the messages are made, so that those are not shuffled, and written in order, so that a window reads its rows alone
    placed = run.save(dense_order(candidates, "ord", ["pair_no", "phrase_no", "target_no"]), "placed")
    answered = run.answers_until(requests.generation_requests(placed), "generation", max_consecutive, "place", retry_failed).drop("place")
    made = run.save(counterfactual_rows(answered), "counterfactuals")
    run.drop("placed")
    return made


def screen(run: Run, counterfactuals: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The three gates; each model gate only sees what the gates before let through.

    The verdict stages hold keys and verdicts only, so the texts are shuffled and
    written again just once, for the filtered table. Gates that were asked about the
    same texts before are not asked again.
    """
    ruled = gates.heuristic_gate(counterfactuals)
    said = gates.semantic_verdicts(run.answers(requests.semantic_requests(ruled), "semantic", retry_failed, example="ord", texts=False))
    semantic = run.save(said.select(*requests.ROW_KEYS, "matched_pattern"), "semantic")
    gated = gates.overlay(ruled, semantic, ["matched_pattern"])
    said = gates.discriminator_verdicts(
        run.answers(requests.discriminator_requests(gated), "discriminator", retry_failed, example="ord", texts=False)
    )
    verdicts = run.save(said.select(*requests.ROW_KEYS, "is_ori", "is_target"), "discriminator")
    # keys meet first, so that the texts are shuffled once for both gates
    both = gates.overlay(semantic, verdicts, ["is_ori", "is_target"])
    return run.save(gates.overlay(ruled, both, ["matched_pattern", "is_ori", "is_target"]), "filtered")


def augment(
    run: Run,
    examples: DataFrame,
    per_label: int | None = 50,
    exclude: Sequence[str] = (),
    token_limit: int | None = None,
    max_consecutive: int | None = None,
    retry_failed: bool = False,
) -> DataFrame:
    """All stages from labelled examples to the training export.

    ``per_label`` (50, as in the original task; None takes all) and batches of 20 are features. ``token_limit``
    and ``max_consecutive`` cut a run, and a later run goes on; ``retry_failed`` asks failed calls again.
    """
    patterns = find_patterns(run, examples, per_label, exclude, retry_failed)
    candidates = find_candidates(run, patterns, examples, exclude, token_limit, retry_failed)
    filtered = screen(run, generate(run, candidates, max_consecutive, retry_failed), retry_failed)
    return run.save(gates.export_fine_tune(filtered), "fine_tune")
