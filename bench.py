"""Time the headline queries and print one JSON line.

BENCH_SF_DIR selects the data (default /root/testdata/sf0.1) and BENCH_CPUS the
local cores (default 8). Every query is built and run in full into a no-op sink;
planning time is included. One untimed pass over the smallest tables beside the
selected ones warms the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "best_document_per_posting_o6_j14",
    "keywords_t1_t2_t3_a3_n3",
    "structure_jobs_c2_w5_w6_w7_w8_w9_t16",
    "analyse_postings_c1",
    "score_pairs_c4_a1_a4_t5",
    "match_aggressive_match_c3_j8",
    "audit_issues_c5_a16_j12_w14_a11_a21",
    "close_gaps_c6_n6_g5_t30_t31_t34_t35",
    "unique_links_w1_j2_t10",
    "history_c7_j1_o1_p5",
    "record_counts_j3_a5",
    "stage_report_a12_c8",
]


def main() -> None:
    from vitagrain.catalog import registry
    from vitagrain.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    smallest = Path(folder).parent / "sf0.001"
    if smallest.is_dir():
        for name in HEADLINE:
            queries[name](spark, str(smallest)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float((re.findall(r"sf([0-9.]+)", folder) or ["0"])[-1]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
