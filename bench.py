"""Headline timings as one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "profile_lineitem", "profile_documents", "table_profile", "clean_rows", "clean_changes_by_rule",
    "clean_change_log_cap", "clean_duplicates", "std_contact_rows", "std_changes_by_rule", "std_date", "std_currency",
    "match_exact_groups", "match_pair_counts", "match_groups", "match_groups_single", "match_groups_uncapped",
    "match_decision_log_cap", "match_summary", "export_rows", "export_counts", "review_queue_page",
    "review_queue_summary", "retention_plan", "retention_backlog", "review_actions_status", "lineage_gate",
    "duration_histogram", "expectations", "secret_key_scan",
)


def main() -> None:
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")
    import suite
    from tidyledger.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='bench-checkpoints-')}",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        suite.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
