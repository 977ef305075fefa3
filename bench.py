"""Benchmark: headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logscope.plans import catalog  # noqa: E402
from logscope.session import local_session  # noqa: E402

# headline queries: context selection (near, lexical, semantic), the full line pipeline,
# the score distribution, per-class evaluation, the file-mode budget + prompt path, templates and detectors
HEADLINE = ["near_context", "far_lexical", "far_semantic", "explain_lines", "score_distribution", "per_class",
            "file_prompts", "templates_iplom", "isolation_forest", "lof"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", int(cpus) * 2)), app="logscope-bench")
    # warm-up: JVM, Python workers, parquet footers
    catalog.QUERIES["run_summary"](spark, sf_dir).collect()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            df = catalog.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
