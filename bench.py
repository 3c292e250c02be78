"""Time the headline queries, the second of two runs each, and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from talentweave import registry  # noqa: E402
from talentweave.session import build_session  # noqa: E402

HEADLINE = [
    "leave_last_out",
    "popularity_ranking",
    "rule_ranking",
    "rule_report",
    "bm25_ranking_v2",
    "dense_ranking",
    "document_frequency",
    "skill_vocabulary",
    "dictionary_matches",
    "graph_edges",
    "graph_nodes",
    "pair_features_v2",
    "match_evidence_v2",
    "propagated_vectors",
    "uniform_negatives",
    "two_stage_rule",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    # the first scan and the first Python worker are not part of any query
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds, first = {}, {}
    for name in names:
        for held in (first, seconds):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            held[name] = round(time.perf_counter() - start, 3)
    tables = ("events", "part", "customer", "documents", "benchmark", "embeddings")
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in tables}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "first_runs": first, "input_rows": rows, "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
