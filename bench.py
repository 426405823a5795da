"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "mix_datasets", "exact_topk_inner_product", "group_advantage", "gae", "loss_aot_pair", "throughput_windows",
    "profile_dataset", "unified_runs_page", "project_checks", "render_training_text", "tokenize", "pack_sequences",
    "loss_sigmoid_family", "kto_loss", "loss_reductions", "high_entropy_mask", "per_prompt_advantage", "progress_state",
    "transition_guard", "throughput_windows_session",
]


def main() -> None:
    from millrace.plans import all_queries
    from millrace.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for i in range(runs + 1):  # the first run warms up
            t = time.perf_counter()
            qs[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        times[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 4), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
