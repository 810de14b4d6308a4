"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Each query runs once to warm up code generation and is then timed; all rows are produced
(noop sink), none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafstack.queries import QUERIES  # noqa: E402
from leafstack.session import local_session  # noqa: E402

HEADLINE = [
    "match_outcome_counts", "match_checks", "validate", "proofread_scores", "instructions_fired", "classify",
    "simhash", "exact_dups", "near_dups", "segment_pages", "page_budget", "page_profile", "extract_fields",
    "field_stats", "discover_variants", "link_components", "link_arrival_order", "usage_audit",
    "quality_audit", "cost_report", "event_timeline", "doc_search", "posting_payloads", "route_documents",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
