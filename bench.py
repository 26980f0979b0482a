"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from logtel.plans.catalog import QUERIES
from logtel.session import build_session

HEADLINE = (
    "checkpoint_frontier",
    "partition_backlog",
    "dispositions",
    "checkpoint_progression",
    "bounded_read",
    "incremental_pull",
    "size_bounded_batches",
    "source_metrics",
    "poll_throughput",
    "duration_stats",
    "pair_stage_spans",
    "stage_lanes",
    "stage_timeline",
    "run_bounds",
    "run_throughput",
    "pipeline_snapshots",
    "summarize_iterations",
    "assemble_events",
    "reassemble_lines",
    "distinct_keys",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        int(cpus),
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.local.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["checkpoint_frontier"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
