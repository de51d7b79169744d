"""Sparse Spark operators against the dense NumPy model on random small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dense_model import Dense, call_sim, cosine_sim, cousage_sim, dbscan, DEFAULT_HYBRID_PLAN, run
from strata.functions.prefix import cosine_at_least
from strata.functions.similarity import call_similarity, cosine_similarity, cousage_similarity
from strata.operators.components import connected_components
from strata.operators.dbscan import dbscan_labels
from strata.plans import analyses
from strata.plans.analyses import CallAnalysis, CombinedAnalysis, TermAnalysis
from strata.plans.decompose import cluster


def rand_edges(rng, n, p=0.3, self_calls=True):
    X = (rng.random((n, n)) < p) * rng.integers(1, 5, (n, n))
    if not self_calls:
        np.fill_diagonal(X, 0)
    return X.astype(float)


def edge_df(spark, X):
    rows = [(int(i), int(j), float(X[i, j])) for i, j in zip(*np.nonzero(X))]
    return spark.createDataFrame(rows, "src long, dst long, w double")


def vec_df(spark, V, key="node"):
    rows = [(int(i), f"t{j}", float(V[i, j])) for i, j in zip(*np.nonzero(V))]
    return spark.createDataFrame(rows, f"{key} long, term string, x double")


def dense_of(df, n):
    M = np.zeros((n, n))
    for r in df.collect():
        M[r.i, r.j] = r.sim
    return M


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similarities_equal_dense(spark, seed):
    rng = np.random.default_rng(seed)
    n = 9
    X = rand_edges(rng, n, self_calls=seed != 2)
    X[:, 3] = 0  # a node nobody calls
    E = edge_df(spark, X)
    assert np.allclose(dense_of(call_similarity(E), n), call_sim(X))
    assert np.allclose(dense_of(cousage_similarity(E), n), cousage_sim(X))
    assert np.allclose(dense_of(cousage_similarity(E, salt_threshold=2), n), cousage_sim(X))
    V = (rng.random((n, 6)) < 0.4) * rng.random((n, 6))
    V[4] = 0  # a zero vector
    S = cosine_sim(V)
    np.fill_diagonal(S, np.where(np.abs(V).sum(1) > 0, 1.0, 0.0))
    got = dense_of(cosine_similarity(vec_df(spark, V)), n)
    assert np.allclose(got, S)
    assert np.allclose(got, got.T) and got.min() >= 0 and got.max() <= 1 + 1e-12


@pytest.mark.parametrize("tau", [0.3, 0.6, 0.9])
def test_prefix_cosine_exact(spark, tau):
    rng = np.random.default_rng(7)
    n = 30
    V = (rng.random((n, 12)) < 0.3) * rng.integers(1, 6, (n, 12))
    V[5] = V[6]  # a duplicate
    S = cosine_sim(V.astype(float))
    got = dense_of(cosine_at_least(vec_df(spark, V.astype(float)), tau, salt_threshold=4), n)
    want = np.where(S >= tau - 1e-9, S, 0.0)
    assert np.allclose(got, want)


def test_connected_components_random(spark):
    rng = np.random.default_rng(3)
    n = 60
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (50, 2)) if a != b}
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = {r.node: r.label for r in connected_components(df).collect()}
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    comps = {}
    for v in {x for p in pairs for x in p}:
        comps.setdefault(find(v), []).append(v)
    want = {v: min(m) for m in comps.values() for v in m}
    assert got == want


@pytest.mark.parametrize("ms,eps", [(1, 0.3), (2, 0.5), (3, 0.7), (4, 0.85)])
def test_dbscan_equals_scan_order(spark, ms, eps):
    rng = np.random.default_rng(ms)
    n = 25
    A = rng.random((n, n)) * (rng.random((n, n)) < 0.25)
    S = np.maximum(A, A.T)
    np.fill_diagonal(S, (rng.random(n) < 0.7) * 1.0)
    rows = [(int(i), int(j), float(S[i, j])) for i, j in zip(*np.nonzero(S))]
    sim = spark.createDataFrame(rows, "i long, j long, sim double")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = {r.node: r.label for r in dbscan_labels(sim, nodes, eps, ms).collect()}
    lab = dbscan(np.maximum(0, 1 - S), eps, ms)
    want = {}
    for i in range(n):
        if lab[i] == -1:
            want[i] = -1
        else:
            want[i] = min(k for k in range(n) if lab[k] == lab[i])
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_term_ladder_with_duplicates_equals_dense(spark, seed):
    rng = np.random.default_rng(seed)
    n = 16
    V = (rng.random((n, 6)) < 0.35) * rng.integers(1, 4, (n, 6)).astype(float)
    V[3] = V[1]
    V[8] = V[1]
    V[12] = V[10]
    V[14] = 0
    atoms = spark.createDataFrame([(str(i), i) for i in range(n)], "atom string, idx long")
    sem = TermAnalysis(vec_df(spark, V, key="idx"), spark.range(n).withColumnRenamed("id", "idx"))
    res = cluster(atoms, [sem], epsilons=[0.65], min_samples=3, strategy="sequential", epsilon_step=0.1)
    got = {}
    for r in res.layers().collect():
        got.setdefault(r.layer, np.zeros(n, dtype=int))[r.idx] = r.cid
    from dense_model import canonical
    plan = [(0, e) for e in (1e-10, 0.1000000001, 0.2000000001, 0.3000000001, 0.4000000001, 0.5000000001, 0.6000000001)]
    want = run(n, [Dense("terms", V, list(range(n)))], plan, 3)
    assert len(got) == len(want)
    for k, w in enumerate(want):
        assert list(got[k]) == list(canonical(w)), k


@pytest.mark.slow
def test_hybrid_ladder_equals_dense(spark):
    rng = np.random.default_rng(11)
    n = 14
    Xd = rand_edges(rng, n, 0.2)
    dsup = [0, 1, 2, 3, 5, 8, 9, 12]
    Xd_sup = Xd[np.ix_(dsup, dsup)]
    Xs = rand_edges(rng, n, 0.25)
    V = (rng.random((n, 5)) < 0.4) * rng.integers(1, 4, (n, 5)).astype(float)
    V[7] = V[2]
    V[9] = V[2]
    V[11] = 2 * V[4]  # duplicate groups (equal unit vectors)
    atoms = spark.createDataFrame([(str(i), i) for i in range(n)], "atom string, idx long")
    sup_rows = [(int(dsup[i]), int(dsup[j]), float(Xd_sup[i, j])) for i, j in zip(*np.nonzero(Xd_sup))]
    dyn = CallAnalysis(spark.createDataFrame(sup_rows, "src long, dst long, w double"),
                       spark.createDataFrame([(d,) for d in dsup], "idx long"))
    st = CallAnalysis(edge_df(spark, Xs), spark.range(n).withColumnRenamed("id", "idx"))
    sem = TermAnalysis(vec_df(spark, V, key="idx"), spark.range(n).withColumnRenamed("id", "idx"))
    res = cluster(atoms, [dyn, CombinedAnalysis([st, sem])], epsilons=[0.65, 0.65], min_samples=2,
                  strategy="alternating_epsilon")
    got = {}
    for r in res.layers().collect():
        got.setdefault(r.layer, np.zeros(n, dtype=int))[r.idx] = r.cid
    Dd = np.zeros((n, n))
    Dd[np.ix_(dsup, dsup)] = Xd_sup
    stages = [Dense("call", Dd, dsup), Dense("sum", children=[Dense("call", Xs, list(range(n))),
                                                              Dense("terms", V, list(range(n)))])]
    want = run(n, stages, DEFAULT_HYBRID_PLAN, 2)
    assert len(got) == len(want) == 27
    for k, w in enumerate(want):
        assert list(got[k]) == list(w), k


@pytest.mark.parametrize("salt", [None, 3])
def test_similarity_after_a_merge_is_carried_on(spark, monkeypatch, salt):
    """Two merges in a row, then the table equals the one computed anew, from joins of the merged nodes alone."""
    r = np.random.default_rng(8)
    rows = [(i, f"t{t}", float(r.integers(1, 9))) for i in range(40) for t in r.choice(12, 5, replace=False)]
    vectors = spark.createDataFrame(rows, "idx long, term string, x double")
    atoms = spark.range(40).select(F.col("id").alias("idx"))
    reach, asked = 0.6, []
    real = analyses.cosine_at_least
    monkeypatch.setattr(analyses, "cosine_at_least", lambda *a, **k: asked.append(k.get("changed")) or real(*a, **k))

    def state(moves, read):
        a = TermAnalysis(vectors, salt_threshold=salt)
        a.bind(atoms)
        a.seed(atoms.select("idx", F.col("idx").alias("cid")))
        for m in moves:
            if read:
                a.similarity(reach)
            a.apply_moves(spark.createDataFrame(m, "node long, new long"))
        return {(x.i, x.j): round(x.sim, 9) for x in a.similarity(reach).collect()}

    steps = [[(5, 1), (9, 1), (20, 3)], [(3, 1), (30, 12), (39, 38)]]
    got = state(steps, True)
    assert [c is None for c in asked] == [True, False, False]
    assert {r.node for r in asked[1].collect()} == {1, 3}
    asked.clear()
    assert got == state(steps, False) and asked == [None]
    # merges without a reading in between: what was carried is carried on
    a = TermAnalysis(vectors, salt_threshold=salt)
    a.bind(atoms)
    a.seed(atoms.select("idx", F.col("idx").alias("cid")))
    a.similarity(reach)
    for m in steps:
        a.apply_moves(spark.createDataFrame(m, "node long, new long"))
    assert got == {(x.i, x.j): round(x.sim, 9) for x in a.similarity(reach).collect()}
    assert {r.node for r in asked[-1].collect()} == {1, 12, 38}
