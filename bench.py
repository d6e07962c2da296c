"""Headline queries, timed once each after one warm-up; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spellframe.session import local_session  # noqa: E402
from workload import catalogue  # noqa: E402

HEADLINE = [
    "active_by_quarter", "clean_summary", "primary_panel", "status_runs", "run_classes", "transitions", "person_summary",
    "endpoint_measures", "cross_measures", "location_missingness", "coverage_report", "title_audit",
    "dedupe_quarantined", "key_checks", "column_profile", "join_audits", "lines_with_orders",
    "coverage_sets", "coverage_ranges", "linked_extract", "null_branch_match", "top_matches", "disjoint_batches",
    "hash_sample", "stratified_pick", "history_sample", "monthly_trend", "evidence_failures", "taxonomy_match_lines",
    "language_groups", "language_scores", "pages_text",
]


def run(df) -> None:
    """Compute every row and column without shipping them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "spellframe-bench")
    run(catalogue.QUERIES["group_counts"](spark, sf_dir))
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        run(catalogue.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
