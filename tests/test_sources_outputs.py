"""Sources (S*, R*), outputs (A9, W*), configuration (K*) and schedules."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators.outliers import cluster_sizes, tag_outliers
from strata.plans import config as K
from strata.plans.analyses import CallAnalysis, CombinedAnalysis, TermAnalysis
from strata.plans.decompose import cluster, cluster_from_scratch
from strata.plans.outputs import layer_arrays, layers_wide, partition_lists, partitions, write_layers, write_metadata
from strata.plans.pipeline import build_analysis, decompose
from strata.plans.schedule import plan, radii, validate
from strata.sources.derive import (
    atoms_from_json,
    atoms_from_list,
    index_atoms,
    relation_edges,
    tfidf,
    trace_edges,
    word_counts,
)
from strata.sources.readers import (
    edges_from_npy,
    load_inputs,
    positions_to_names,
    read_table,
    save_inputs,
    unpivot_matrix,
)


def test_trace_edges_hot_split_equals_plain(spark):
    rows = [(t, ts, int(a)) for t in range(3) for ts, a in enumerate(np.random.default_rng(t).integers(0, 4, 50 + 40 * t))]
    rows += [(9, 5, 1), (9, 5, 2)]  # equal first ordering values, broken by the second column
    df = spark.createDataFrame(rows, "tr long, ts long, a long").withColumn("tie", F.col("a"))
    plain = sorted(trace_edges(df, "tr", ["ts", "tie"], "a").collect())
    split = sorted(trace_edges(df, "tr", ["ts", "tie"], "a", hot_threshold=17).collect())
    assert plain == split
    # brute force
    want = {}
    by = {}
    for t, ts, a in rows:
        by.setdefault(t, []).append((ts, a, a))
    for seq in by.values():
        seq.sort()
        for x, y in zip(seq, seq[1:]):
            want[(x[2], y[2])] = want.get((x[2], y[2]), 0) + 1
    assert {(r.src, r.dst): r.w for r in plain} == want


def test_relation_word_counts_tfidf(spark):
    docs = spark.createDataFrame([(1, "The cat, the HAT!"), (2, "a cat"), (3, "")], "id long, text string")
    wc = {(r.idx, r.term): r.n for r in word_counts(docs, "id", "text").collect()}
    assert wc == {(1, "the"): 2, (1, "cat"): 1, (1, "hat"): 1, (2, "a"): 1, (2, "cat"): 1}
    tf = {(r.idx, r.term): r.x for r in tfidf(word_counts(docs, "id", "text")).collect()}
    n = 2  # entities with at least one term
    assert tf[(1, "the")] == pytest.approx(2 * (np.log((1 + n) / (1 + 1)) + 1))
    assert tf[(2, "cat")] == pytest.approx(1 * (np.log((1 + n) / (1 + 2)) + 1))
    rel = spark.createDataFrame([(1, 2, 3.0), (1, 2, 4.0), (2, 1, 1.0)], "a long, b long, v double")
    assert sorted(tuple(r) for r in relation_edges(rel, "a", "b").collect()) == [(1, 2, 2.0), (2, 1, 1.0)]
    assert sorted(tuple(r) for r in relation_edges(rel, "a", "b", "v").collect()) == [(1, 2, 7.0), (2, 1, 1.0)]


def test_atom_indices(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    assert sorted(tuple(r) for r in index_atoms(df, "k").collect()) == [("a", 0), ("b", 1), ("c", 2)]
    j = spark.createDataFrame([('["x","y","z"]',)], "names string")
    assert [tuple(r) for r in atoms_from_json(j, "names").orderBy("idx").collect()] == [("x", 0), ("y", 1), ("z", 2)]
    assert atoms_from_list(spark, ["p", "q"]).count() == 2


def test_unpivot_npy_and_readers(spark, tmp_path):
    wide = spark.createDataFrame([("a", 0.0, 2.0), ("b", 1.0, 0.0)], "atom string, a double, b double")
    assert sorted(tuple(r) for r in unpivot_matrix(wide, "atom", "calls").collect()) == [("a", "b", 2.0), ("b", "a", 1.0)]
    terms = unpivot_matrix(wide, "atom", "terms")
    assert sorted(tuple(r) for r in terms.collect()) == [("a", "b", 2.0), ("b", "a", 1.0)]
    X = np.array([[0, 2, 0], [1, 0, 0], [0, 0, 5]], dtype=float)
    path = str(tmp_path / "m.npy")
    np.save(path, X)
    pos = edges_from_npy(spark, path, block_bytes=40)
    names = atoms_from_list(spark, ["u", "v", "w"])
    got = sorted(tuple(r) for r in positions_to_names(pos, names).collect())
    assert got == [("u", "v", 2.0), ("v", "u", 1.0), ("w", "w", 5.0)]
    with pytest.raises(ValueError):
        read_table(spark, path, "pickle")
    base = str(tmp_path / "data")
    e = spark.createDataFrame([("u", "v", 1.0)], "src string, dst string, w double")
    save_inputs(e, names, base, "structural")
    f, n = load_inputs(spark, "structural", base_path=base)
    assert f.count() == 1 and n.count() == 3
    with pytest.raises(ValueError):
        load_inputs(spark, "dynamic", base_path=base)
    with pytest.raises(ValueError):
        load_inputs(spark, "bogus")


def test_config_merge_expand_validate():
    d = K.default_params()
    m = K.merge_params({"clustering": {"min_samples": 3}, "extra": {"a": 1}}, d)
    assert m["clustering"]["min_samples"] == 3 and m["clustering"]["epsilon_step"] == 0.05 and m["extra"] == {"a": 1}
    stages = K.expand_pipeline(K.PIPELINES["hybrid"], m)
    assert [k for k, _ in stages] == ["dynamic", "sum"]
    assert [k for k, _ in stages[1][1]["analysis"]] == ["structural", "semantic"]
    nested = K.expand_pipeline([["structural", ["semantic", "dynamic"]]], m)[0][1]["analysis"]
    assert [k for k, _ in nested] == ["structural", "sum"] and [k for k, _ in nested[1][1]["analysis"]] == ["semantic", "dynamic"]
    with pytest.raises(ValueError):
        K.expand_pipeline(["unheard"], m)
    with pytest.raises(ValueError):
        validate("bogus", 1, None)
    with pytest.raises(ValueError):
        validate("sequential", 2, [0.5])
    with pytest.raises(ValueError):
        K.resolve_pipeline("nope")


def test_schedules():
    expected = [1e-10] + [round(0.05 * k, 2) + 1e-10 for k in range(1, 13)]
    assert radii(0.65, 0.05) == pytest.approx(expected, abs=1e-14)
    assert radii(0.03, 0.05) == [1e-10] and radii(1e-10, 0.05) == [] and radii(0.0, 0.05, whole=True) == [1e-10]
    both = plan("alternating_epsilon", [0.65, 0.65], 0.05)
    assert [k for k, _ in both] == [0, 1] * 13 and [e for k, e in both if k == 1] == pytest.approx(expected, abs=1e-14)
    two = plan("alternating_epsilon", [0.2, 0.65], 0.05)
    assert len(two) == 26 and [e for k, e in two if k == 0][4:] == [0.2] * 9
    one = plan("sequential", [0.65, 0.03], 0.05)
    assert one == [(0, e) for e in radii(0.65, 0.05)] + [(1, 1e-10)]


def test_analysis_errors(spark):
    e = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double")
    with pytest.raises(ValueError):
        CallAnalysis(e, similarity="nope")
    v = spark.createDataFrame([(0, "t", 1.0)], "idx long, term string, x double")
    with pytest.raises(ValueError):
        TermAnalysis(v, aggregation="median")
    with pytest.raises(ValueError):
        CombinedAnalysis([CallAnalysis(e)])
    with pytest.raises(ValueError):
        CombinedAnalysis([CallAnalysis(e), TermAnalysis(v)], weights=[0.5, 0.6])
    with pytest.raises(ValueError):
        build_analysis("bogus", {}, {})
    atoms = spark.range(1).withColumnRenamed("id", "idx")
    t = TermAnalysis(spark.createDataFrame([(5, "t", 1.0)], "idx long, term string, x double"))
    with pytest.raises(ValueError):  # P2: semantic support outside the universe
        t.bind(atoms)
    c = CallAnalysis(spark.createDataFrame([(0, 5, 1.0)], "src long, dst long, w double"))
    c.bind(atoms)  # P1: dropped silently
    assert [r.idx for r in c.support.collect()] == [0]


def test_outputs(spark, tmp_path):
    atoms = atoms_from_list(spark, ["a", "b", "c", "d"])
    layers = spark.createDataFrame(
        [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 2)],
        "layer int, idx long, cid long",
    )
    final = layers.where("layer = 1").select("idx", "cid")
    assert [tuple(r) for r in partitions(final, atoms).collect()] == [
        ("partition0", 0, 0, "a"), ("partition0", 0, 1, "b"), ("partition2", 2, 2, "c"), ("partition2", 2, 3, "d")]
    pl = {r.partition: r.members for r in partition_lists(final, atoms).collect()}
    assert pl == {"partition0": ["a", "b"], "partition2": ["c", "d"]}
    with pytest.raises(ValueError):
        partition_lists(final, atoms, max_members=1)
    arr = {r.name: r.clusters for r in layer_arrays(layers).collect()}
    assert arr == {"layer_0": [0, 1, 2, 3], "layer_1": [0, 0, 2, 2]}
    wide = layers_wide(layers, atoms)
    assert wide.columns == ["layer", "a", "b", "c", "d"]
    with pytest.raises(ValueError):
        layers_wide(layers, atoms, max_columns=3)
    sizes = {(r.layer, r.cid): r.size for r in cluster_sizes(layers).collect()}
    assert sizes[(1, 0)] == 2 and sizes[(0, 3)] == 1
    tagged = {(r.layer, r.idx): r.cid for r in tag_outliers(layers, 2).collect()}
    assert tagged[(0, 0)] == -1 and tagged[(1, 3)] == 2
    write_layers(layers, str(tmp_path / "layers"))
    assert {"layer=0", "layer=1"} <= set(os.listdir(tmp_path / "layers"))


@pytest.mark.slow
def test_alternating_and_scratch_and_metadata(spark, tmp_path):
    atoms = atoms_from_list(spark, [str(i) for i in range(6)])
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0), (3, 4, 1.0)],
                              "src long, dst long, w double")
    v = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0), (2, "b", 1.0), (5, "b", 1.0)], "idx long, term string, x double")
    res = cluster(atoms, [TermAnalysis(v), CallAnalysis(e)], epsilons=[0.1, 0.1], strategy="alternating",
                  max_iterations=10)
    assert res.n_layers <= 1 + 2 * 10
    parts = {}
    for r in res.final().collect():
        parts.setdefault(r.cid, []).append(r.idx)
    assert sorted(map(sorted, parts.values())) == [[0, 1], [2, 5], [3], [4]]
    scratch = {r.idx: r.cid for r in cluster_from_scratch(TermAnalysis(v), atoms, 0.1, 2).collect()}
    assert scratch == {0: 0, 1: 0, 2: 2, 5: 2, 3: -1, 4: -1}
    sup = spark.range(6).withColumnRenamed("id", "idx")
    out = decompose(spark, atoms, {"structural": (e, sup), "semantic": (v, sup)}, pipeline="static",
                    params={"clustering": {"strategy": "sequential"}, "semantic": {"aggregation": "sum"}})
    write_metadata(out.metadata, str(tmp_path / "meta"))
    files = [f for f in os.listdir(tmp_path / "meta") if f.endswith(".json")]
    meta = json.loads(open(tmp_path / "meta" / files[0]).read())
    assert meta["experiment_id"] == "static_app" and meta["layers"] == 14
