"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. Every query writes all
its rows to a sink that drops them.
"""

import json
import os
import time

from leadrank.plans.catalog import QUERIES
from leadrank.session import local_session

HEADLINES = (
    "precision_at_5",
    "top_companies",
    "ranked_scores",
    "model_comparison",
    "stage_priorities",
    "weighted_totals",
    "run_summaries",
    "run_reports",
    "normalized_names",
    "canonical_urls",
    "trigger_fingerprints",
    "response_evidence",
    "sourced_candidates",
    "reviewed_candidates",
    "strict_evaluations",
    "legacy_scores",
    "valid_attempts",
    "resolved_companies",
    "deduped_triggers",
    "triggers_to_score",
    "assigned_ids",
    "generated_answers",
    "message_pieces",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, shuffle_partitions=int(cores))
    # One untimed run, so that the first query does not measure the start of the JVM.
    QUERIES[HEADLINES[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
