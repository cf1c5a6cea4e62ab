"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (folder of Parquet tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import time

from rowproof.plans.queries import QUERIES
from rowproof.session import local_session, prepare

HEADLINES = (
    "findings_ranked",
    "findings_lineitem",
    "score_batch",
    "latest_per_key",
    "prepare_transactions",
    "contract_check",
    "profile_transactions",
    "duplicate_summary",
    "join_quality",
    "distribution",
    "record_ids",
    "inject_transactions",
    "baseline_metrics",
    "features_fit_numeric",
    "features_transaction",
    "rank_percentile",
    "lof_scores",
    "iforest_scores",
    "guarded_queue",
    "eval_record",
    "feedback_split",
    "rerank_metrics",
    "stream_findings",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = prepare(local_session(cores, partitions=cores))
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths and the Python workers before timing
    QUERIES["findings_ranked"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
