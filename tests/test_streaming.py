"""Incremental edges over several micro-batches equal the batch edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.sources.derive import trace_edges
from strata.streaming.edges import stream_trace_edges
from strata.streaming.relink import merged, trimmed


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(6):
        for k in range(30):
            rows.append((t, k, f"e{int(rng.integers(0, 4))}"))
    df = spark.createDataFrame(rows, "user long, ts long, kind string")
    folder = str(tmp_path / "events")
    # three files, in time order, so traces continue across micro-batches
    for lo, hi in ((0, 10), (10, 20), (20, 30)):
        df.where(f"ts >= {lo} and ts < {hi}").coalesce(1).write.mode("append").parquet(folder)
    got = stream_trace_edges(spark, folder, "user", ["ts"], "kind", max_files_per_trigger=1)
    want = trace_edges(spark.read.parquet(folder), "user", ["ts"], "kind")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _edges(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["long", "timestamp"])
def test_rows_out_of_order_are_linked_again(spark, tmp_path, kind):
    r = random.Random(11)
    rows = [(r.choice([0, 1, 2, 3, None]), k, i, r.choice("abcd") if i % 17 else None) for i, k in enumerate(r.choices(range(600), k=500))]
    df = spark.createDataFrame(rows, "user long, ts long, id long, kind string")
    if kind == "timestamp":
        df = df.withColumn("ts", F.timestamp_seconds("ts"))
    folder = str(tmp_path / "events")
    # six files; a row comes up to two files late, so most batches bring rows older than what is linked
    place = {i: min(5, k // 100 + r.choice([0, 0, 1, 2])) for _, k, i, _ in rows}
    known = spark.createDataFrame(list(place.items()), "id long, file int")
    for f in range(6):
        df.join(known, "id").where(f"file = {f}").drop("file").coalesce(1).write.mode("append").parquet(folder)
    want = _edges(trace_edges(df, "user", ["ts", "id"], "kind"))
    state = str(tmp_path / "state")
    got = stream_trace_edges(spark, folder, "user", ["ts", "id"], "kind", max_files_per_trigger=1, folder=state,
                             lateness="400 seconds")
    assert _edges(got) == want
    epochs = spark.read.parquet(f"{state}/edges").select("epoch").distinct().count()
    assert epochs >= 6 and spark.read.parquet(f"{state}/edges").where("w < 0").count() > 0
    # the folder goes on: one more row inside the bound, linked between old ones
    more = df.limit(0).union(df.where("ts is not null").orderBy(F.desc("ts")).limit(1).withColumn("id", F.lit(9999).cast("long")))
    more.write.mode("append").parquet(folder)
    got = stream_trace_edges(spark, folder, "user", ["ts", "id"], "kind", folder=state, lateness="400 seconds")
    assert _edges(got) == _edges(trace_edges(df.union(more), "user", ["ts", "id"], "kind"))


def test_rows_beyond_the_bound_are_reported(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(rows, "user long, ts long, kind string").coalesce(1)
    folder, state = str(tmp_path / "events"), str(tmp_path / "state")
    for rows in (((1, 100, "a"), (1, 300, "c"), (2, 5, "x")), ((1, 400, "d"),), ((1, 10, "z"), (1, 350, "b"), (2, 390, "y"))):
        batch(*rows).write.mode("append").parquet(folder)
    with pytest.warns(UserWarning, match="1 rows"):
        got = stream_trace_edges(spark, folder, "user", ["ts"], "kind", max_files_per_trigger=1, folder=state,
                                 lateness="100 seconds")
    assert _edges(got) == [("a", "c", 1.0), ("b", "d", 1.0), ("c", "b", 1.0), ("x", "y", 1.0)]


def test_a_list_holds_the_bound_and_one_row():
    rows = [(k * 10, k, "abc"[k % 3]) for k in range(9)]
    assert trimmed(rows, 45) == rows[4:] and trimmed(rows, 1000) == rows[-1:] and trimmed(rows, -1) == rows
    held, change = merged(rows[4:6], [rows[6], (45, 4.5, "x")], 0)
    assert [r[-1] for r in held] == ["b", "x", "c", "a"]
    assert {k: n for k, n in change.items() if n} == {("b", "x"): 1, ("x", "c"): 1, ("b", "c"): -1, ("c", "a"): 1}
