"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores.
Each query runs into a no-op sink, so all its rows are computed and none are
collected. ``BENCH_QUERIES`` (comma-separated, or ``all``) picks other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import QUERIES  # noqa: E402
from mirrorset.session import local_session  # noqa: E402

HEADLINE = [
    "heuristic_filter",
    "seeded_shuffle",
    "shuffle_lineitem",
    "sample_per_label",
    "first_per_id",
    "prompt_batches",
    "parse_structured",
    "parse_natural",
    "parse_cascade",
    "match_sentences",
    "candidate_requests",
    "parse_candidates",
    "staged_gates",
    "fine_tune_export",
    "augment_run",
    "few_shot_context",
    "metrics_by_shots",
    "prefix_metrics",
    "token_usage",
    "token_budget",
    "failure_streak_cut",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if picked == "all" else picked.split(",") if picked else HEADLINE

    spark = local_session(cpus, "mirrorset-bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").count().collect()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
