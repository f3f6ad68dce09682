"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera import registry
from tessera.session import local_session

NAMES = ("dsl_group_agg", "dsl_reverse_join", "dsl_select_chain", "via_two_hop", "take_dedup", "intersect", "agg_sum", "group_top_sum", "profile_table", "sample_seeded", "fk_orphans", "categorical_topk", "exact_dedup", "early_stop_batches", "breaker_rolling", "backoff_runs", "quality_gate")


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}
    known["where_eq"](spark, root).collect()  # starts the session's workers
    for name in NAMES:
        times = []
        for _ in range(2):
            began = time.perf_counter()
            known[name](spark, root).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 4)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(root.rstrip("/").rsplit("sf", 1)[-1]) if "sf" in root else None}))
    spark.stop()


if __name__ == "__main__":
    main()
