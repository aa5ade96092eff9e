"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) set
the input and the local core count.  The tables are first stored the way the
library lays them out (timed as ``setup_sec``); each query then reads those
and the raw driver tables and is written to the noop sink, so every row and
column is computed.  The best of BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skein.plans.fixtures import StoredFixtures
from skein.plans.registry import load_all
from skein.session import PARSE_PARTITIONS, build_session, shared_dir
from skein.sources.tablestore import TableStore

HEADLINE = [
    "unread_first_pages",
    "feed_timeline",
    "folder_timeline",
    "search_literal",
    "search_postings",
    "fan_out",
    "unread_counts",
    "subscription_views",
    "user_stats",
    "upsert_entries",
    "mark_ids_read",
    "expired_entries",
    "per_feed_cap_excess",
    "block_diff",
    "watch_decision",
    "page_blocks",
    "repeated_subtrees",
    "removed_boilerplate",
    "fetch_duration_histogram",
    "canonical_url",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            PARSE_PARTITIONS: cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    start = time.time()
    store = TableStore(spark, f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}")
    tables = StoredFixtures.build(spark, sf_dir, store)
    setup = time.time() - start
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.time()
            catalog[name].run(tables).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - start)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "setup_sec": round(setup, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
