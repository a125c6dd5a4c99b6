"""Time the headline queries, after one untimed run each; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated names, or "all"), BENCH_RUNS (timed runs, 2).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "prompt_glyphs",
    "box_downsample",
    "pixelize",
    "quantize",
    "normal_maps",
    "center_align_bottom",
    "relit_pairs",
    "packed_sheets",
    "animation_sheets",
    "image_integrity",
    "image_differences",
    "routed_requests",
    "layered_params",
    "latest_run_status",
    "manifest_result_rows",
    "missing_artifact_files",
    "streamed_run_status",
    "spritify",
    "single_sprite",
)


def main() -> None:
    from pixelloom.plans.catalog import QUERIES
    from pixelloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", cpus)
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # start the JVM and the executors
    seconds: dict[str, float] = {}
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    for name in names:
        taken = []
        for _ in range(runs + 1):  # the first run compiles the plan's code and does not count
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
