"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradesift.plans import lead_queries, licence_queries  # noqa: E402
from tradesift.session import build_session  # noqa: E402

#: Run three times after a warm run, as the baseline asks for throughput; the others run once.
REPEATED = {"flagship_matches": 3, "normalize_leads": 3}
QUERIES = {
    "flagship_matches": lead_queries.flagship,
    "normalize_leads": lead_queries.n15_normalized_lead,
    "verdict_counts": lead_queries.g1_verdict_counts,
    "profile_grid": lead_queries.f18_profile_grid,
    "exact_duplicates": lead_queries.d6_exact_duplicates,
    "scan_outcomes": lead_queries.v6_scan_outcomes,
    "customer_search": licence_queries.b5_customer_search,
    "licence_rows": licence_queries.b3_licence_rows,
    "command_replay": licence_queries.b15_command_replay,
    "state_at_event": licence_queries.a2_state_at_event,
    "card_extraction": licence_queries.x1_extract_cards,
}


def seconds(spark, query, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # the dimension tables are small only here: joins shuffle, as they do on large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    licence_queries.b1_effective_status(spark, folder).count()
    timings = {}
    for name, query in QUERIES.items():
        times = REPEATED.get(name, 1)
        if times > 1:
            seconds(spark, query, folder)
        timings[name] = round(statistics.median(seconds(spark, query, folder) for _ in range(times)), 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
