"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads), BENCH_QUERIES (comma-separated names, "all" for every one).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from eviflow.plans import catalog  # noqa: E402
from eviflow.session import configured  # noqa: E402

HEADLINE = [
    "crosscheck_mismatch", "crosscheck_values", "chunks_with_offsets", "sentences", "tfidf_topk", "dense_topk", "baseline_assessment",
    "compile_rules", "guard_eval", "guard_verdicts", "fund_guards", "registry_lookup", "banned_matches", "coi_check", "latest_verdicts",
    "case_queue", "dashboard", "post_audit_candidates", "sign_report", "transition_violations", "chain_build", "chain_verify",
    "eval_accuracy", "testset_eval", "leak_problems", "classify_labels", "feedback_samples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    builder = configured(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.eviflow.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # One untimed query starts the JVM, the Python workers and the file cache.
    catalog.QUERIES["name_scores"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if wanted == "all":
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
