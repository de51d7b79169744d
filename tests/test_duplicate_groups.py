"""Duplicate groups as weighted nodes: the same clusters as with every pair of members listed."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators.dbscan import dbscan_labels, merge_radius, neighbour_counts_cliques
from strata.plans.analyses import CallAnalysis, CombinedAnalysis, TermAnalysis

N = 36


def vectors(r):
    """A third of the nodes shares one vector; the others hold close or far ones, some of them twice."""
    kinds = [{"a": 2.0, "b": 1.0}, {"a": 2.0, "b": 1.3}, {"a": 1.0, "c": 1.0}, {"a": 2.0, "c": 1.0, "d": 1.0}, {"d": 1.0},
             {"d": 2.0, "e": 1.0}, {"f": 3.0}]
    own = [kinds[0]] * (N // 3) + [r.choice(kinds[1:]) for _ in range(N - N // 3 - 1)]
    r.shuffle(own)
    return [(i, t, x) for i, v in enumerate(own) for t, x in v.items()]  # the last node has no vector


def bound(spark, analysis, collapse):
    nodes = spark.range(N).withColumnRenamed("id", "idx")
    for a in [analysis, *getattr(analysis, "children", [])]:
        a.collapse_duplicates = collapse
    analysis.bind(nodes)
    analysis.seed(nodes.select("idx", F.col("idx").alias("cid")))
    return analysis


def built(spark, kind, seed):
    r = random.Random(seed)
    sup = spark.range(N).withColumnRenamed("id", "idx")
    terms = TermAnalysis(spark.createDataFrame(vectors(r), "idx long, term string, x double"), sup)
    if kind == "terms":
        return terms
    edges = [(r.randrange(N), r.randrange(N), float(r.randrange(1, 5))) for _ in range(40)]
    return CombinedAnalysis([CallAnalysis(spark.createDataFrame(edges, "src long, dst long, w double"), sup), terms],
                            [0.4, 0.6])


@pytest.mark.parametrize("kind,seed,mode", [("terms", 1, "always"), ("combined", 2, "distance")])
def test_clusters_equal_those_of_all_pairs(spark, kind, seed, mode):
    reach = 0.75
    weighted, listed = (bound(spark, built(spark, kind, seed), c) for c in (True, False))
    sim, full = weighted.similarity(reach), listed.similarity(reach)
    assert weighted.links_at(reach).count() and listed.links_at(reach) is None
    for eps, k in [(0.45, 15), (0.7, 20)]:
        groups, links = weighted.cliques_at(eps), weighted.links_at(eps)
        got = {r.node: r.label for r in dbscan_labels(
            sim, weighted.nodes(), eps, k, mode, cliques=groups, links=links).collect()}
        want = {r.node: r.label for r in dbscan_labels(full, listed.nodes(), eps, k, mode).collect()}
        assert got == want, (eps, k)
    first = merge_radius(sim, 15, mode, weighted.cliques_at(reach), weighted._clique_eps, weighted.links_at(reach))
    assert first <= merge_radius(full, 15, mode)
    counts = [{r.node: r.n_neighbours for r in neighbour_counts_cliques(
        a.similarity(reach), 0.7, a.cliques_at(0.7), links=a.links_at(0.7)).collect()} for a in (weighted, listed)]
    assert counts[0] == counts[1]


def test_rows_grow_with_the_groups_not_their_members(spark):
    def rows(copies):
        own = [{"a": 1.0, "b": 1.0}] * copies + [{"a": 1.0, "b": 0.9}] * copies + [{"a": 1.0, "b": 0.8}] * copies
        v = [(i, t, x) for i, d in enumerate(own) for t, x in d.items()]
        a = TermAnalysis(spark.createDataFrame(v, "idx long, term string, x double"))
        nodes = spark.range(3 * copies).withColumnRenamed("id", "idx")
        a.bind(nodes)
        a.seed(nodes.select("idx", F.col("idx").alias("cid")))
        listed = a.similarity(0.2).count() + a.links_at(0.2).count()
        labels = dbscan_labels(a.similarity(0.2), a.nodes(), 0.2, 2, cliques=a.cliques_at(0.2), links=a.links_at(0.2))
        assert {r.label for r in labels.collect()} == {0}
        return listed

    assert rows(4) == rows(200) == 3
