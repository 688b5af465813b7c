"""Times the headline queries: one cold run each, JSON on one line."""

import json
import os
import sys
import time

QUERIES = ("gate_edges", "net_table", "degrees", "check_floating_net", "check_multi_driver", "check_missing_pin",
           "levels", "gate_components", "structure_features", "depth_encoding", "propagated_features",
           "smoothed_probabilities", "bill_of_materials", "duplicate_gates", "scores_by_circuit", "check_claims",
           "sampled_walks", "support_sets")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from wireloom.plans.catalog import QUERIES as ALL
    from wireloom.session import local_session
    spark = local_session(cpus, app="bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in QUERIES:
        t0 = time.time()
        ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
