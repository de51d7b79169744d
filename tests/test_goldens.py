"""Golden fixtures F1, G1-G6 (FIXTURES.md)."""

import pytest

from strata.functions.similarity import call_similarity, combine_similarities, cosine_similarity, cousage_similarity
from strata.operators.contract import contract_edges
from strata.operators.dbscan import dbscan_labels, neighbour_counts, neighbours
from strata.operators.project import project
from strata.plans.pipeline import decompose
from strata.sources.derive import atoms_from_list

G1 = [(0, 1, 4.0), (1, 0, 2.0), (1, 2, 1.0), (2, 3, 3.0), (3, 2, 1.0), (4, 3, 1.0)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w double")


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def simmap(df):
    return {(r.i, r.j): r.sim for r in df.collect()}


def labels(df):
    return [r.label for r in sorted(df.collect())]


def test_f1_projection(spark):
    # seeds [0,0,1,4,4,3,3]; supported 0,3,5,6 get new clusters [1,1,0,0]:
    # seed clusters 0 and 4 merge, 3 stays, 1 (unsupported only) keeps its identity
    assign = spark.createDataFrame(list(enumerate([0, 0, 1, 4, 4, 3, 3])), "idx long, cid long")
    moves = spark.createDataFrame([(4, 0)], "node long, new long")
    out = sorted(project(assign, moves).collect())
    parts = {}
    for r in out:
        parts.setdefault(r.cid, set()).add(r.idx)
    assert sorted(map(sorted, parts.values())) == [[0, 1, 3, 4], [2], [5, 6]]


def test_g1_call_similarity_and_self_neighbour(spark):
    s = call_similarity(edges(spark, G1))
    m = simmap(s)
    expect = {(0, 1): 1.0, (1, 2): 0.25, (2, 3): 0.625, (3, 4): 0.25}
    for (i, j), v in expect.items():
        assert m[(i, j)] == pytest.approx(v) and m[(j, i)] == pytest.approx(v)
    assert len(m) == 8  # diagonal is 0 (no self calls): absent
    for eps in (0.2, 0.35, 0.5, 0.65):
        assert labels(dbscan_labels(s, nodes(spark, 5), eps, 2)) == [-1] * 5
    counts = {r.node: r.n_neighbours for r in neighbour_counts(neighbours(s, 0.65), 2).collect()}
    assert counts == {0: 1, 1: 1, 2: 1, 3: 1}


def test_g2_cousage(spark):
    s = cousage_similarity(edges(spark, G1))
    m = simmap(s)
    assert [m.get((i, i), 0.0) for i in range(5)] == [1.0, 1.0, 1.0, 1.0, 0.0]
    assert {k: v for k, v in m.items() if k[0] != k[1]} == {(0, 2): 0.5, (2, 0): 0.5}
    assert labels(dbscan_labels(s, nodes(spark, 5), 0.5, 2)) == [0, -1, 0, -1, -1]


def test_g3_border_goes_to_lower_cluster(spark):
    pairs = [(0, 1, .9), (0, 2, .9), (1, 2, .9), (4, 5, .9), (4, 6, .9), (5, 6, .9), (2, 3, .6), (3, 4, .6)]
    rows = [(i, i, 1.0) for i in range(7)] + pairs + [(b, a, s) for a, b, s in pairs]
    S = spark.createDataFrame(rows, "i long, j long, sim double")
    assert labels(dbscan_labels(S, nodes(spark, 7), 0.45, 4)) == [0, 0, 0, 0, 4, 4, 4]
    assert labels(dbscan_labels(S, nodes(spark, 7), 0.45, 3)) == [0] * 7


def test_g4_contraction(spark):
    assign = spark.createDataFrame(list(enumerate([0, 0, 2, 2, 4])), "idx long, cid long")
    c = contract_edges(edges(spark, G1), assign)
    assert sorted((r.src, r.dst, r.w) for r in c.collect()) == [(0, 0, 6.0), (0, 2, 1.0), (2, 2, 4.0), (4, 2, 1.0)]
    m = simmap(call_similarity(c))
    assert m[(0, 0)] == pytest.approx(1.0)
    assert m[(0, 2)] == pytest.approx(0.083333, abs=1e-6)
    assert m[(2, 2)] == pytest.approx(0.666667, abs=1e-6)
    assert m[(2, 4)] == pytest.approx(0.166667, abs=1e-6)
    assert (4, 4) not in m


def test_g5_cosine_and_combined(spark):
    vec = {0: (1, 1, 0), 1: (2, 2, 0), 2: (0, 1, 1), 3: (0, 0, 1), 4: (0, 0, 0)}
    rows = [(i, f"t{k}", float(x)) for i, v in vec.items() for k, x in enumerate(v) if x]
    V = spark.createDataFrame(rows, "node long, term string, x double")
    cos = cosine_similarity(V)
    m = simmap(cos)
    assert m[(0, 1)] == pytest.approx(1.0) and m[(0, 2)] == pytest.approx(0.5)
    assert m[(1, 2)] == pytest.approx(0.5) and m[(2, 3)] == pytest.approx(0.707107, abs=1e-6)
    assert [m.get((i, i), 0.0) for i in range(5)] == pytest.approx([1, 1, 1, 1, 0])
    comb = combine_similarities([call_similarity(edges(spark, G1)), cos])
    c = simmap(comb)
    assert c[(0, 1)] == pytest.approx(1.0) and c[(0, 2)] == pytest.approx(0.25)
    assert c[(1, 2)] == pytest.approx(0.375) and c[(2, 3)] == pytest.approx(0.666053, abs=1e-6)
    assert c[(3, 4)] == pytest.approx(0.125)
    assert [c.get((i, i), 0.0) for i in range(5)] == pytest.approx([0.5, 0.5, 0.5, 0.5, 0])
    assert labels(dbscan_labels(comb, nodes(spark, 5), 0.65, 2)) == [0, 0, 0, 0, -1]


def g6_inputs(spark):
    se = edges(spark, [(0, 1, 4.), (1, 0, 4.), (1, 2, 1.), (2, 3, 5.), (3, 2, 5.), (4, 3, 1.), (4, 5, 2.), (5, 4, 2.), (0, 6, 1.)])
    vec = {0: (1, 1, 0, 0), 1: (1, 1, 0, 0), 2: (0, 1, 1, 0), 3: (0, 0, 1, 0), 4: (0, 0, 0, 1), 5: (0, 0, 1, 1), 6: (0, 0, 0, 0)}
    rows = [(i, f"t{k}", float(v)) for i, vs in vec.items() for k, v in enumerate(vs) if v]
    terms = spark.createDataFrame(rows, "idx long, term string, x double")
    sup = spark.range(7).withColumnRenamed("id", "idx")
    de = edges(spark, [(0, 2, 3.), (2, 0, 3.), (2, 3, 1.), (3, 2, 1.)])
    dsup = spark.createDataFrame([(0,), (2,), (3,)], "idx long")
    return {"structural": (se, sup), "semantic": (terms, sup), "dynamic": (de, dsup)}


def partitions_by_layer(layers_df):
    by = {}
    for r in layers_df.collect():
        by.setdefault(r.layer, {}).setdefault(r.cid, []).append(r.idx)
    return {k: sorted(sorted(v) for v in d.values()) for k, d in by.items()}


def changes(parts):
    out, prev = {}, None
    for k in sorted(parts):
        if parts[k] != prev:
            out[k] = parts[k]
        prev = parts[k]
    return out


@pytest.mark.slow
def test_g6_static_and_hybrid(spark):
    atoms = atoms_from_list(spark, [str(i) for i in range(7)])
    inputs = g6_inputs(spark)
    static = decompose(spark, atoms, inputs, pipeline="static")
    p = partitions_by_layer(static.layers)
    assert len(p) == 14
    assert changes(p) == {0: [[k] for k in range(7)], 11: [[0, 1], [2, 3], [4, 5], [6]]}
    hybrid = decompose(spark, atoms, inputs, pipeline="hybrid", params={"clustering": {"include_outliers": True}})
    h = decompose(spark, atoms, inputs, pipeline="hybrid")
    p = partitions_by_layer(h.layers)
    assert len(p) == 27
    assert changes(p) == {
        0: [[k] for k in range(7)],
        17: [[0, 2, 3], [1], [4], [5], [6]],
        18: [[0, 1, 2, 3], [4], [5], [6]],
        22: [[0, 1, 2, 3], [4, 5], [6]],
    }
    # the compact form rebuilds every layer
    cur = {k: k for k in range(7)}
    deltas = {}
    for r in h.run.changes().collect():
        deltas.setdefault(r.layer, []).append((r.idx, r.cid))
    full = {}
    for r in h.layers.collect():
        full.setdefault(r.layer, {})[r.idx] = r.cid
    for k in range(27):
        for idx, cid in deltas.get(k, []):
            cur[idx] = cid
        assert cur == full[k], k
    assert sorted(deltas) == [17, 18, 22]
    final = {r.idx: r.cid for r in hybrid.final.collect()}
    assert final[6] == -1 and final[4] == final[5] != -1
    meta = hybrid.metadata.first()
    assert meta.layers == 27 and meta.merging_steps == 3
    assert set(meta.exec_time) >= {"total", "clustering"}
