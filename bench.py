"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is executed in full (``noop`` sink) and timed separately; the
decomposition also reports its layer count and merging steps.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata import catalog as C  # noqa: E402
from strata.plans.pipeline import decompose  # noqa: E402
from strata.session import local_session  # noqa: E402
from strata.sources.derive import atoms_from_keys  # noqa: E402

HEADLINE = [
    "r1_order_adjacency_edges",
    "r2_trade_edges",
    "r4_tfidf_docs",
    "m1_call_similarity_parts",
    "m3_cosine_docs",
    "c1_dbscan_docs",
    "m5_combined_parts_mean",
    "c9_ladder_docs",
    "r6_stream_event_edges",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="strata-bench")
    # warm-up: JVM and codegen, on a tiny table
    run(C.q_trade_edges(spark, "/root/testdata/sf0.001"))
    times: dict[str, float] = {}
    extra: dict[str, object] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        run(C.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    if not only or "k1_hybrid_parts" in only:
        t0 = time.time()
        atoms = atoms_from_keys(C.table(spark, sf_dir, "part"), "p_partkey")
        res = decompose(spark, atoms, C.part_inputs(spark, sf_dir), pipeline="hybrid", app="parts")
        run(res.final)
        times["k1_hybrid_parts"] = round(time.time() - t0, 3)
        extra["hybrid_layers"] = res.run.n_layers
        extra["hybrid_merging_steps"] = res.run.merging_steps
        extra["hybrid_final_clusters"] = res.final.select("cid").distinct().count()
        extra["hybrid_step_seconds_max"] = round(max(s.seconds for s in res.run.steps), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        **extra,
    }))


if __name__ == "__main__":
    main()
