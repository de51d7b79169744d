"""Ladder steps that merge nothing, layers as intervals, traces of many pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.similarity import cousage_similarity
from strata.operators.dbscan import dbscan, merge_radius
from strata.operators.outliers import tag_outlier_intervals, tag_outliers
from strata.plans.analyses import TermAnalysis
from strata.plans.decompose import cluster, layer_at
from strata.plans.outputs import write_layer_intervals
from strata.sources.derive import trace_edges


def table(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, sim double")


def both(pairs):
    return [x for i, j, s in pairs for x in {(i, j, s), (j, i, s)}]


def plain_radius(sim, n, k, mode, group=None, from_=0.0):
    """The first distance at which a core node has another neighbour, by trying all of them."""
    d = {(i, j): round(max(0.0, 1.0 - s), 12) for i, j, s in sim}
    tries = sorted({0.0, from_, *d.values()})
    for eps in tries:
        for i in range(n):
            near = {j for j in range(n) if d.get((i, j), 2.0) <= eps and (mode == "distance" or i != j)}
            if mode == "always":
                near.add(i)
            if group is not None and eps >= from_:
                own = {j for j in range(n) if group[j] == group[i]}
                if len(own) > 1:
                    near |= own
            if len(near) >= k and near - {i}:
                return eps
    return float("inf")


@pytest.mark.parametrize("mode", ["distance", "always"])
def test_first_merging_radius(spark, mode):
    rng = random.Random(5)
    for trial in range(2):
        n = 7
        own = [(i, i, rng.choice([1.0, 0.7, 0.35])) for i in range(n)]
        some = [(i, j, round(rng.random(), 2)) for i in range(n) for j in range(i) if rng.random() < 0.4]
        rows = [r for r in both(own + some) if r[2] > 0]
        sim = table(spark, rows).persist()
        for k in (1, 2, 4):
            want = plain_radius(rows, n, k, mode)
            got = merge_radius(sim, k, mode)
            assert got == pytest.approx(want)
            nodes = spark.range(n).withColumnRenamed("id", "node")
            if trial == 0 and want < 1:  # what the step itself says, at the radius and below it
                assert not dbscan(sim, nodes, want, k, mode).trivial
                assert want < 1e-6 or dbscan(sim, nodes, want - 1e-6, k, mode).trivial
        sim.unpersist()


@pytest.mark.parametrize("from_", [0.0, 0.3])
def test_first_merging_radius_with_cliques(spark, from_):
    group = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    cliques = spark.createDataFrame([(i, g, sum(h == g for h in group.values())) for i, g in group.items()],
                                    "node long, g long, m long")
    rng = random.Random(9)
    for _ in range(2):
        pairs = [(i, j, round(0.2 + 0.75 * rng.random(), 2)) for i in group for j in range(i)
                 if group[i] != group[j] and rng.random() < 0.5]
        inside = [] if from_ == 0.0 else [(0, 1, 0.9)]
        rows = both(pairs + inside + [(i, i, 1.0) for i in group])
        for k in (2, 4):
            for mode in ("distance", "always"):
                assert merge_radius(table(spark, rows), k, mode, cliques, from_) == pytest.approx(
                    plain_radius(rows, len(group), k, mode, group, from_))


def test_no_table_no_merge(spark):
    empty = table(spark, [])
    assert merge_radius(empty, 2) == float("inf") and merge_radius(table(spark, [(0, 0, 1.0), (1, 1, 1.0)]), 1) == float("inf")


def ladder(spark, **options):
    rng = np.random.default_rng(3)
    rows = [(i, f"t{t}", float(x)) for i in range(14) for t, x in enumerate(rng.random(6) + (np.arange(6) == i % 4) * 2.0)]
    atoms = spark.range(14).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("atom"))
    return cluster(atoms, [TermAnalysis(spark.createDataFrame(rows, "idx long, term string, x double"))],
                   epsilons=[0.3], epsilon_step=0.03, strategy="sequential", **options)


def test_layers_as_intervals(spark, tmp_path):
    run = ladder(spark)
    assert run.merging_steps >= 2
    want = {(k, r.idx, r.cid) for k, h in enumerate(run.handles) for r in h.collect()}
    assert {(r.layer, r.idx, r.cid) for r in run.layers().collect()} == want
    path = str(tmp_path / "intervals")
    write_layer_intervals(run.intervals(), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 14 + run.changes().count() < len(want)
    for k in (0, run.n_layers - 1):
        assert {(r.idx, r.cid) for r in layer_at(stored, k).collect()} == {(i, c) for layer, i, c in want if layer == k}


@pytest.mark.parametrize("size", [1, 3])
def test_outliers_in_intervals(spark, size):
    run = ladder(spark)
    want = sorted(map(tuple, tag_outliers(run.layers(), size).select("layer", "idx", "cid").collect()))
    tagged = tag_outlier_intervals(run.intervals(), size)
    got = tagged.select(F.explode(F.sequence("first_layer", "last_layer")).alias("layer"), "idx", "cid")
    assert sorted(map(tuple, got.collect())) == want


def test_a_step_below_the_first_merge_runs_no_job(spark):
    """Orthogonal vectors never merge: after the first step of the ladder the others start no job."""
    atoms = spark.range(5).select(F.col("id").alias("idx"))
    vectors = atoms.select("idx", F.concat(F.lit("t"), "idx").alias("term"), F.lit(1.0).alias("x"))
    tracker, seen = spark.sparkContext.statusTracker(), []
    jobs = lambda: len(tracker.getJobIdsForGroup(None))
    cluster(atoms, [TermAnalysis(vectors)], epsilons=[0.4], epsilon_step=0.05, strategy="sequential",
            log=lambda info: seen.append(jobs()))
    assert len(seen) == 8 and len(set(seen)) == 1 and seen[0] > 0


def test_a_trace_of_a_thousand_pieces(spark):
    df = spark.range(20_000).select(F.lit(1).alias("t"), "id", (F.col("id") * 7 % 13).alias("a"))
    got = {(r.src, r.dst): r.w for r in trace_edges(df, "t", ["id"], "a", hot_threshold=20).collect()}
    assert got == {(r.src, r.dst): r.w for r in trace_edges(df, "t", ["id"], "a").collect()}


@pytest.mark.parametrize("hot", [0, 8, 10_000])
def test_cousage_of_nodes_with_many_callers(spark, hot):
    """Prefixes of hot nodes come from counts; the pairs are the same for every threshold."""
    rng = random.Random(2)
    callers = {node: {rng.randrange(30) for _ in range(rng.choice([3, 12, 40]))} for node in range(12)}
    callers[12], callers[13] = set(range(30)), set(range(1, 30))
    rows = [(100 + c, node, 1.0) for node, own in callers.items() for c in own]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    want = {(i, j): len(a & b) / len(a | b) for i, a in callers.items() for j, b in callers.items()}
    got = {(r.i, r.j): r.sim for r in cousage_similarity(edges, reach=0.6, hot_callers=hot).collect()}
    assert got == pytest.approx({p: s for p, s in want.items() if round(1 - s, 12) <= 0.6})
