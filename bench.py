"""Headline queries at one scale, one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
    BENCH_WORK (folder for intermediate tables; default a new temporary one)
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from hushframe.plans import catalog
from hushframe.session import build_session

HEADLINES = [
    "detect_spans", "anonymize_documents", "sensitivity_report", "rehydrate_session", "rate_limit",
    "stream_rehydrate", "keyword_flags", "chunk_text", "detect_two_pass", "chat_anonymize", "deny_list_join",
    "codenames_pool",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_WORK") or tempfile.mkdtemp(prefix="bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        times = []
        for i in range(runs + 1):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            # The first run warms up.
            if i or runs == 0:
                times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
