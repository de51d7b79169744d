"""One radius test everywhere: pairs on the radius, reused analyses, user clusterers, pruned co-usage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.similarity import cousage_similarity, within
from strata.operators.dbscan import neighbour_counts_cliques, neighbours
from strata.plans.analyses import Analysis, CallAnalysis, CombinedAnalysis, TermAnalysis
from strata.plans.decompose import cluster, cluster_from_scratch
from strata.plans.pipeline import decompose


def atoms(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("atom"))


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cid"], set()).add(r["idx"])
    return sorted(map(sorted, out.values()))


class Given(Analysis):
    """A fixed similarity table on the first contraction (later ones keep the largest value)."""

    def __init__(self, rows):
        super().__init__()
        self.rows = rows

    def bind(self, universe):
        self._support = universe.select("idx")
        spark = universe.sparkSession
        self.state = spark.createDataFrame(
            [x for i, j, s in self.rows for x in ((i, j, s), (j, i, s))], "i long, j long, sim double").distinct()

    def _seed_state(self, assign):
        pass

    def _move_state(self, moves):
        m = {r["node"]: r["new"] for r in moves.collect()}
        best = {}
        for r in self.state.collect():
            key = (m.get(r["i"], r["i"]), m.get(r["j"], r["j"]))
            best[key] = max(best.get(key, 0.0), r["sim"])
        self.state = self.state.sparkSession.createDataFrame(
            [(i, j, s) for (i, j), s in best.items()], "i long, j long, sim double")

    def _compute_similarity(self, reach):
        return self.state.where(within(F.col("sim"), reach)) if reach < 1 else self.state


def test_pairs_on_the_radius_are_neighbours(spark):
    """1 - 0.7 is above 0.3 in floats, but a pair of similarity 0.3 is at distance 0.7."""
    rows = [(0, 3, 0.9), (1, 2, 0.9), (0, 1, 0.3)] + [(i, i, 1.0) for i in range(4)]
    for strategy in ("alternating", "sequential"):
        run = cluster(atoms(spark, 4), [Given(rows)], epsilons=[0.7], strategy=strategy, epsilon_step=0.7 - 1e-10)
        if strategy == "alternating":
            assert groups(run.final()) == [[0, 1, 2, 3]]
    assert groups(cluster_from_scratch(Given(rows), atoms(spark, 4), 0.7, 2)) == [[0, 1, 2, 3]]


@pytest.mark.parametrize("eps", [0.7, 0.3, 0.1, 0.45, 0.9])
def test_call_pairs_on_the_radius(spark, eps):
    """Two nodes whose call similarity is exactly 1 - eps: w calls of 100 into each."""
    w = round(100 * (1 - eps))
    edges = spark.createDataFrame(
        [(0, 1, float(w)), (2, 1, float(100 - w)), (1, 0, float(w)), (2, 0, float(100 - w))],
        "src long, dst long, w double")
    a = CallAnalysis(edges, spark.range(3).withColumnRenamed("id", "idx"))
    got = cluster(atoms(spark, 3), [a], epsilons=[eps], strategy="alternating", min_samples=1).final()
    sim = w / 100
    assert ([0, 1] in [g[:2] for g in groups(got)]) == (round(1 - sim, 12) <= eps)


def test_combined_pairs_on_the_radius(spark):
    vectors = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (2, "b", 1.0)], "idx long, term string, x double")
    none = spark.createDataFrame([(2, 2, 1.0)], "src long, dst long, w double")
    sup = spark.range(3).withColumnRenamed("id", "idx")
    a = CombinedAnalysis([CallAnalysis(none, sup), TermAnalysis(vectors, sup)], [0.7, 0.3])
    got = cluster(atoms(spark, 3), [a], epsilons=[0.7], strategy="alternating", min_samples=2).final()
    assert groups(got) == [[0, 1], [2]]


def test_every_pair_on_the_radius_is_a_neighbour(spark):
    """eps = 1 - s in floats may lie a little below the rounded distance of s."""
    tested = [k / 100 for k in range(1, 100)]
    sim = spark.createDataFrame([(k, k, s) for k, s in enumerate(tested)], "i long, j long, sim double")
    for k in range(0, len(tested), 9):
        found = {r.i for r in neighbours(sim, 1 - tested[k]).collect()}
        assert found == set(range(k, len(tested))), tested[k]


@pytest.mark.parametrize("weights", [[0.8, -0.8, 1.0], [0.5, 1.5, -1.0], [-0.5, 0.5, 1.0], [2.0, 0.5, -1.5]])
@pytest.mark.parametrize("eps", [0.3, 0.85])
def test_weights_of_both_signs(spark, weights, eps):
    """Neighbour counts of two edge children and a term child with duplicates equal the dense combination."""
    r = random.Random(repr(weights))
    n, sup = 14, spark.range(14).withColumnRenamed("id", "idx")
    edges = [[(r.randrange(n), r.randrange(n), float(r.randrange(1, 5))) for _ in range(20)] for _ in range(2)]
    words = [[("a", 1.0), ("b", 2.0)]] * 4 + [[(r.choice("abcd"), float(r.randrange(1, 4))), ("e", 1.0)] for _ in range(n - 4)]
    vectors = [(i, t, x) for i, own in enumerate(words) for t, x in dict(own).items()]
    frames = [spark.createDataFrame(e, "src long, dst long, w double") for e in edges]
    kids = [CallAnalysis(f, sup) for f in frames] + [
        TermAnalysis(spark.createDataFrame(vectors, "idx long, term string, x double"), sup)]
    a = CombinedAnalysis(kids, weights)
    a.bind(sup)
    a.seed(sup.select("idx", F.col("idx").alias("cid")))
    got = {r.node: r.n_neighbours for r in neighbour_counts_cliques(
        a.similarity(eps), eps, a.cliques_at(eps), links=a.links_at(eps)).collect()}
    full = {}
    for k, w in zip(kids, weights):
        for row in k.full_similarity().collect():
            full[row.i, row.j] = full.get((row.i, row.j), 0.0) + w * row.sim
    want = {}
    for (i, j), s in full.items():
        if round(max(0.0, 1.0 - min(s, 1.0)), 12) <= round(eps, 12):
            want[i] = want.get(i, 0) + 1
    assert got == want


def test_an_analysis_may_serve_several_stages(spark):
    rows = [(0, 1, 0.5), (2, 3, 0.95)] + [(i, i, 1.0) for i in range(4)]
    a = Given(rows)
    run = cluster(atoms(spark, 4), [a, a], epsilons=[0.6, 0.1], strategy="alternating")
    assert groups(run.final()) == [[0, 1], [2, 3]]


def test_a_clusterer_gets_every_pair(spark):
    rows = [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (3, "c", 1.0)]
    a = TermAnalysis(spark.createDataFrame(rows, "idx long, term string, x double"))
    seen = {}

    def clusterer(sim, nodes, eps, min_samples):
        seen.update({(r["i"], r["j"]): r["sim"] for r in sim.collect()})
        top = sim.where("i < j and sim > 0.99").groupBy(F.col("j").alias("node")).agg(F.min("i").alias("label"))
        return top.unionByName(top.select(F.col("label").alias("node"), "label")).distinct()

    run = cluster(atoms(spark, 4), [a], epsilons=[0.05], strategy="alternating", max_iterations=1, clusterer=clusterer)
    assert seen[0, 1] == pytest.approx(1.0) and (0, 2) in seen
    assert groups(run.final()) == [[0, 1], [2], [3]]


@pytest.mark.parametrize("reach", [0.0, 0.2, 0.5, 0.75, 0.99])
def test_pruned_cousage_equals_full(spark, reach):
    rng = np.random.default_rng(3)
    x = (rng.random((30, 25)) < 0.2) | (rng.random((30, 1)) < 0.1)  # some hub callers
    x[:, 7] = x[:, 4]
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(x))], "src long, dst long, w double")
    full = {(r["i"], r["j"]): r["sim"] for r in cousage_similarity(edges).where(within(F.col("sim"), reach)).collect()}
    got = {(r["i"], r["j"]): r["sim"] for r in cousage_similarity(edges, reach=reach).collect()}
    assert got == pytest.approx(full) and len(full) >= 25


def test_nested_and_custom_kinds_in_combined_stages(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    vectors = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0), (2, "b", 1.0)], "idx long, term string, x double")
    sup = spark.range(3).withColumnRenamed("id", "idx")
    inputs = {"structural": (edges, sup), "dynamic": (edges, sup), "semantic": (vectors, sup)}
    mine = Given([(0, 1, 1.0), (0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)])
    res = decompose(spark, atoms(spark, 3), inputs, pipeline=[["structural", ["semantic", "mine"]], "dynamic"],
                    params={"mine": {"epsilon": 0.5}}, analyses={"mine": mine})
    assert groups(res.final)[0][:2] == [0, 1]
    times = res.metadata.first()["exec_time"]
    assert {"load_0_sum", "load_1_dynamic", "clustering", "total"} <= set(times)
