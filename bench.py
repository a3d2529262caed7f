"""Run the headline queries and print one JSON line with their times.

Every query is built and written to the no-op sink, so all rows are computed; nothing is kept from one run to the
next. One untimed query warms the JVM up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from judgealign import build_session
from judgealign.plans import catalog

HEADLINE = [
    "align_trials_by_dim",
    "align_spearman",
    "align_kendall",
    "align_kendall_continuous",
    "align_mape_r2",
    "trial_consistency",
    "ratings_policy_fill1",
    "folder_report",
    "folder_records",
    "gate_auc",
    "archetype_gate_report",
    "describe_predictions",
    "box_table",
    "extract_answer_score",
    "extract_report_patterns",
    "separate_merge",
    "request_separate",
    "fewshot_similar",
    "fewshot_random",
    "corpus_role",
    "corpus_all_flexible_consistent",
    "repeat_sampler",
    "reward_advantage",
    "stream_increment",
    "judge_map",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    spark.catalog.clearCache()
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "success_rates", sf)
    times = {n: round(statistics.median(run(spark, n, sf) for _ in range(repeats)), 3) for n in names}
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
