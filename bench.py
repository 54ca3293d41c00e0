"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Every query runs to
its last row (``noop`` sink), planning included: once on the smallest data to warm
up the JVM, then twice for the clock, of which the faster run is reported.
Tables of one row group are dealt to twice as many tasks as there are cores, by the
session setting for that; inputs with enough blocks of their own need no such shuffle.
"""

from __future__ import annotations

import json
import os
import sys
import time

from promptweave.operators.partitioning import INPUT_TASKS
from promptweave.session import local_session
from workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UP_DIR = os.environ.get("BENCH_WARM_UP_DIR", "/root/testdata/sf0.001")

HEADLINE = (
    "tier_summary",
    "first_prompt",
    "labeled_prompts",
    "drop_audit",
    "model_coverage",
    "tier_report",
    "dense_id",
    "dense_id_lineitem",
    "fetch_tier",
    "stored_summary",
    "documents_tier",
    "csv_roundtrip",
    "word_count",
    "unique_word_ratio",
    "complex_keyword_count",
    "char_entropy",
    "flesch_reading_ease",
    "text_features",
    "feature_describe",
    "lineitem_describe",
    "ngrams",
    "vocab_top",
    "tfidf_long",
    "tfidf_sparsity",
    "feature_matrix",
)


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = local_session(
        "bench",
        CPUS,
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.sql.shuffle.partitions": CPUS,
            # Texts are heavy to work on: small splits keep every core busy.
            "spark.sql.files.maxPartitionBytes": "2m",
            "spark.sql.files.openCostInBytes": "256k",
            INPUT_TASKS: str(2 * int(CPUS)),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, sf_dir: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds = {}
    for name in names:
        run(name, WARM_UP_DIR)
        seconds[name] = min(run(name, SF_DIR) for _ in range(2))
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
