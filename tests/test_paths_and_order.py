"""Any ordering type and late rows, URI paths, the call from stored tables, blocked outputs, unknown names."""

import pytest
from pyspark.sql import functions as F

from strata.plans.outputs import decomposition_table, layer_blocks, partition_blocks
from strata.plans.pipeline import decompose_paths
from strata.sources.derive import to_index, trace_edges, universe
from strata.sources.readers import load_inputs, read_table, save_inputs
from strata.streaming.edges import accumulated_edges, make_batch_handler, stream_trace_edges


def edges(df):
    return {(r["src"], r["dst"]): r["w"] for r in df.collect()}


@pytest.mark.parametrize("threshold", [1, 3, 10, 1000])
def test_traces_in_any_order_type(spark, threshold):
    keys = [str(k) for k in range(40)] + ["x", "", "y z"]  # strings: 10 comes before 2
    rows = [(t, k, i) for t in (1, 2) for i, k in enumerate(keys)] + [(None, "b", 7), (None, "a", 8), (1, None, 9)]
    df = spark.createDataFrame(rows, "t long, k string, a long")
    want = {}
    for t in (1, 2, None):
        own = [a for _, a in sorted(((k is not None, k or ""), a) for tt, k, a in rows if tt == t)]
        for pair in zip(own, own[1:]):
            want[pair] = want.get(pair, 0) + 1
    assert edges(trace_edges(df, "t", ["k"], "a", hot_threshold=threshold)) == want


def test_traces_with_ties_in_the_first_column(spark):
    df = spark.range(300).select(F.lit(1).alias("t"), F.lit(0).alias("same"), "id", (F.col("id") * 7 % 11).alias("a"))
    plain = edges(trace_edges(df, "t", ["same", "id"], "a"))
    assert edges(trace_edges(df, "t", ["same", "id"], "a", hot_threshold=20)) == plain and sum(plain.values()) == 299


def test_late_rows_and_lost_state(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(rows, "user long, ts long, kind string")
    base = str(tmp_path / "state")
    handle, out = make_batch_handler(spark, "user", ["ts"], "kind", base)
    handle(batch((1, 5, "a")), 0)
    handle(batch((1, 3, "b"), (2, 1, "z")), 1)
    handle(batch((1, 7, "c"), (2, 2, "y"), (1, 7, None)), 2)
    handle(batch((1, 7, "c"), (2, 2, "y")), 2)  # again: nothing is counted twice
    assert edges(accumulated_edges(spark, out)) == {("a", "c"): 1.0, ("z", "y"): 1.0}
    assert [tuple(r) for r in spark.read.parquet(f"{base}/late").select("user", "ts", "kind").collect()] == [(1, 3, "b")]
    with pytest.raises(RuntimeError):
        handle(batch((1, 9, "d")), 5)


def test_a_stream_goes_on_in_its_folder(spark, tmp_path):
    rows, folder = str(tmp_path / "events"), str(tmp_path / "run")
    write = lambda *r: spark.createDataFrame(r, "user long, ts long, kind string").coalesce(1).write.mode("append").parquet(rows)
    write((1, 1, "a"), (1, 2, "b"))
    assert edges(stream_trace_edges(spark, rows, "user", ["ts"], "kind", folder=folder)) == {("a", "b"): 1.0}
    write((1, 3, "c"))
    got = edges(stream_trace_edges(spark, rows, "user", ["ts"], "kind", folder=folder))
    assert got == {("a", "b"): 1.0, ("b", "c"): 1.0}


def test_names_to_indices(spark):
    atoms = spark.createDataFrame([("a", 0), ("b", 1)], "atom string, idx long")
    calls = spark.createDataFrame([("a", "b", 1.0), ("a", "x", 1.0)], "src string, dst string, w double")
    assert [(r["src"], r["dst"]) for r in to_index(calls, atoms, ["src", "dst"]).collect()] == [(0, 1)]
    with pytest.raises(ValueError):
        to_index(calls, atoms, ["src", "dst"], "raise")
    assert universe(None, atoms.select("atom")).count() == 2
    with pytest.raises(ValueError):
        universe()


def test_from_stored_tables_to_stored_layers(spark, tmp_path):
    base = "file://" + str(tmp_path / "in")
    names = spark.createDataFrame([("u",), ("v",), ("w",)], "atom string")
    calls = spark.createDataFrame([("u", "v", 1.0), ("v", "u", 1.0), ("u", "ghost", 2.0)], "src string, dst string, w double")
    terms = spark.createDataFrame([("u", "t", 1.0), ("v", "t", 2.0), ("w", "s", 1.0)], "atom string, term string, x double")
    save_inputs(calls, names, base, "structural")
    save_inputs(terms, names, base, "semantic")
    assert load_inputs(spark, "structural", base_path=base)[0].count() == 3
    with pytest.raises(ValueError):
        load_inputs(spark, "dynamic", base_path=base)
    out, kept = "file://" + str(tmp_path / "out"), "file://" + str(tmp_path / "kept")
    res = decompose_paths(spark, "static", base_path=base, save_inputs_to=kept, output_path=out, app="app")
    name = {r["idx"]: r["atom"] for r in res.atoms.collect()}
    parts = {}
    for r in res.final.collect():
        parts.setdefault(r["cid"], set()).add(name[r["idx"]])
    assert sorted(map(sorted, parts.values())) == [["u", "v"], ["w"]]
    assert read_table(spark, f"{out}/layers").count() == 3 * res.run.n_layers
    assert spark.read.json(f"{out}/metadata").first()["experiment_id"] == "static_app"
    assert load_inputs(spark, "semantic", base_path=kept)[0].count() == 3
    with pytest.raises(ValueError):  # semantic input must know its atoms
        decompose_paths(spark, "static", base_path=base, names=names.where("atom != 'w'"))


def test_blocks(spark):
    final = spark.range(25).select(F.col("id").alias("idx"), (F.col("id") % 2).alias("cid"))
    atoms = spark.range(25).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("atom"))
    rows = partition_blocks(final, atoms, 10).orderBy("cid", "block").collect()
    assert [x for r in rows if r["cid"] == 1 for x in r["members"]] == [str(k) for k in range(1, 25, 2)]
    assert max(len(r["members"]) for r in rows) == 5
    layers = final.withColumn("layer", F.lit(3))
    blocks = layer_blocks(layers, 10).orderBy("block").collect()
    assert [x for r in blocks for x in r["clusters"]] == [k % 2 for k in range(25)] and len(blocks) == 3
    table = decomposition_table(final, atoms, "app", "java", "class")
    assert table.columns[:3] == ["app", "language", "level"] and table.count() == 25
