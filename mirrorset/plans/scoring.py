"""Few-shot scoring of a filtered table against a test table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_label
from ..operators import evaluation, gates, labels, requests, runcontrol, sampling
from ..operators.order import pinned
from .run import Run


def build_contexts(
    filtered: DataFrame,
    lookup: DataFrame,
    shots: Sequence[int] = sampling.DEFAULT_SHOTS,
    seeds: Sequence[int] = (42,),
    max_counterfactuals: int = 4,
) -> DataFrame:
    """Contexts per (seed, shots) out of the filtered table.

    Examples are chosen by id alone; texts are read for the chosen ids only, at
    most the largest shot size per seed.
    """
    ids = filtered.select("id").distinct()
    places = pinned(sampling.shot_prefixes(ids, shots, seeds), sum(shots) * len(seeds))
    rows = (
        filtered.join(pinned(places.select("id").distinct(), sum(shots) * len(seeds)), "id", "left_semi")
        .select(
            "id", "ori_text", "ori_label", "target_label", "counterfactual",
            requests.row_order().alias("ord"),
            "heuristic_filtered", "matched_pattern", "is_ori", "is_target",
        )
    )
    first = sampling.first_per_id(rows.select("id", "ori_text", "ori_label", "ord"))
    chosen = places.join(first.drop("ord"), "id")
    accepted = rows.filter(gates.accepted())
    examples = requests.attach_counterfactuals(chosen, accepted, max_counterfactuals)
    return requests.few_shot_context(examples, lookup)


def predictions(answered: DataFrame, lookup: DataFrame) -> DataFrame:
    """Masked truth and stripped prediction of each answered request."""
    kept = runcontrol.apply_failure_default(answered, "scoring")
    masked = labels.mask_labels(kept, lookup, {"label": "y_true"})
    return masked.select(
        "seed", "shots", "test_id", "ord", "y_true", parse_label(F.col("text")).alias("y_pred")
    )


def score(
    run: Run,
    filtered: DataFrame,
    test: DataFrame,
    shots: Sequence[int] = sampling.DEFAULT_SHOTS,
    seeds: Sequence[int] = (42,),
    exclude: Sequence[str] = (),
    max_counterfactuals: int = 4,
) -> DataFrame:
    """Macro scores per (seed, shots) over the whole test table; 4 counterfactuals a shot are a feature."""
    lookup = run.save(labels.label_map(labels.all_labels(filtered, exclude)), "label_map")
    contexts = run.save(
        build_contexts(filtered, lookup, shots, seeds, max_counterfactuals), "contexts"
    )
    asked = requests.scoring_requests(labels.known_labels(test, lookup), shots, seeds)
    answered = run.answers(requests.with_context_id(asked, contexts), "scoring", contexts=contexts)
    scored = run.save(predictions(answered, lookup), "predictions")
    return run.save(evaluation.macro_prf(scored), "metrics")
