"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadloom.plans import registry  # noqa: E402
from threadloom.session import build_session  # noqa: E402

HEADLINES = [
    "build_corpus",
    "report_table",
    "cooccurrence",
    "boxplot_stats",
    "histogram",
    "density_curve",
    "describe_engagement",
    "dedup_first",
    "funnel_audit",
    "term_counts",
    "lexicon_counts",
    "keyword_by_origin",
    "top_discussions",
    "distinct_links_topn",
    "append_new",
    "read_records",
    "page_fields",
    "page_comments",
    "collect_records",
    "append_new_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        "threadloom-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, median seconds after one warm-up",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
