"""Nearest neighbours with an inverted multi-index (operator 3).

The two halves of the vectors are quantised separately; a pair of half centroids is a
cell, and every distinct vector is indexed in its cell.  For a query the cells are visited
in the order of the summed half distances (for inner products: the negated inner product
of a query half with a centroid) with a heap over centroid pairs, until the cells hold
the wanted share of all vectors; their entries are reranked by the exact inner product
in double precision.

Equal vectors are indexed once, with the smallest ``depth`` of their ids, which is all that a
result can hold of them; so a vector that fills a third of the table is one entry.  Queries with
equal vectors are searched once.  Entries are dealt in blocks of cells of equal size
(a large cell is split), queries in blocks of rows, so no task holds all of either.

What reaches the driver is bounded: the sample for the codebooks (``SAMPLE`` distinct vectors,
those of the smallest hash, so the same in every run), the codebooks, and one count per
cell (``K * K``).  Everything else covers all rows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do vectors whose length is not the most frequent one (ties: the longer).  A query with
fewer candidates than ``k`` gets them all; ties go to the smaller id; repeated rows of one
id and vector count once; an empty table, or one without any valid vector, gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

#: Half centroids, sample for them, and k-means rounds.
K = 32
SAMPLE = 8192
ROUNDS = 12
#: A search visits cells until they hold this share of the distinct vectors, and this many at least.
SHARE = 0.65
LEAST = 2000
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 8192


def _valid(embedding):
    x = F.transform(embedding, lambda v: v.cast("double"))
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return embedding.isNotNull() & sound & F.exists(x, lambda v: v != 0)


def distinct_vectors(vectors: DataFrame, vec_id: str, embedding: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """``(entries, members)``: one row ``(class, ids, v)`` per distinct vector, and ``(vec_id, h1, h2)`` of all rows.

    ``class`` is the smallest id, ``ids`` the ``depth`` smallest.  Tasks first keep the smallest ids of
    their own rows, then two aggregations merge them, so a frequent vector never gathers its rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(_valid(F.col("v")), F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.col("n").desc(), F.col("dim").desc()).limit(1).collect()
    dim = best[0]["dim"] if best else 0
    rows = rows.where(F.size("v") == dim).select(
        "vec_id", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")

    def nearest_ids(parts):
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(parts)))), 1, depth)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            t = batch.to_pandas().sort_values("vec_id", kind="stable")
            ids = t.groupby(["h1", "h2"], sort=False)["vec_id"].agg(lambda s: sorted(set(s))[:depth])
            first = t.drop_duplicates(["h1", "h2"]).set_index(["h1", "h2"])["v"]
            out = pd.DataFrame({"ids": ids, "v": first}).reset_index()
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    arrow = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ids", pa.list_(pa.int64())),
                       ("v", pa.list_(pa.float64()))])
    near = rows.mapInArrow(per_task, "h1 long, h2 long, ids array<long>, v array<double>")
    some = near.groupBy("h1", "h2", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(64)).alias("part")).agg(
        nearest_ids("ids").alias("ids"), F.first("v").alias("v"))
    entries = some.groupBy("h1", "h2").agg(nearest_ids("ids").alias("ids"), F.first("v").alias("v"))
    entries = entries.select(F.element_at("ids", 1).alias("class"), "h1", "h2", "ids", "v")
    return entries, rows.select("vec_id", "h1", "h2")


def fit_codebooks(entries: DataFrame, k: int, sample: int, rounds: int) -> np.ndarray | None:
    """Two arrays of half centroids by Lloyd's rounds on at most ``sample`` distinct vectors (None: no vectors)."""
    lot = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30))
    # about twice the sample is looked at, so tasks send few rows; the smallest hashes of them are taken
    share = 2 * sample / max(entries.count(), 1)
    got = entries.where(lot < F.lit(share * (1 << 30))).select("v", lot.alias("lot"), "h1", "h2")
    got = got.orderBy("lot", "h1", "h2").limit(sample).collect()
    if not got:
        return None
    x = np.array([r["v"] for r in got], dtype=float)
    half = (x.shape[1] + 1) // 2
    x = np.pad(x, ((0, 0), (0, 2 * half - x.shape[1])))
    books = []
    for part in (x[:, :half], x[:, half:]):
        rng = np.random.default_rng(0)
        c = part[rng.choice(len(part), min(k, len(part)), replace=False)].copy()
        for _ in range(rounds):
            near = _nearest(part, c)
            for i in range(len(c)):
                own = part[near == i]
                if len(own):
                    c[i] = own.mean(axis=0)
        books.append(c)
    return np.stack(books)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def _halves(v: list, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array(v.tolist() if hasattr(v, "tolist") else v, dtype=float)
    wide = np.pad(x, ((0, 0), (0, 2 * half - x.shape[1])))
    return x, wide[:, :half], wide[:, half:]


def nearest_cells(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
    """Non-empty cells in the order of summed half distances until they hold ``wanted`` entries.

    ``first``, ``second``: distances of the query's halves to the centroids; ``held``: entries per cell.
    """
    a, b, k = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
    d1, d2, a, b, held = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist(), held.tolist()
    heap, seen_row, out, got = [(d1[0] + d2[0], 0, 0)], 0, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        if held[cell]:
            out.append(cell)
            got += held[cell]
        if j + 1 < k:
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # the row below opens when its left neighbour is visited
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return out


def search(
    vectors: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 20,
    centroids: int = K,
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    share: float = SHARE,
    least: int = LEAST,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found per query.

    ``queries`` has a column ``vec_id`` with ids of ``vectors``; a query's own id is no candidate.
    """
    spark = vectors.sparkSession
    if not checkpoint_dir(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    depth = k + 1
    entries, members = distinct_vectors(vectors, vec_id, embedding, depth)
    entries = entries.checkpoint(eager=True)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit_codebooks(entries, centroids, sample, rounds)
    if books is None:
        return empty
    half, kk = books.shape[2], books.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                _, a, b = _halves(batch.column(1).to_pylist(), half)
                cell = _nearest(a, books[0]) * kk + _nearest(b, books[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int64()), batch.column(1)],
                                                 names=["class", "cell", "v"])

    indexed = entries.select("class", "v").mapInArrow(assign, "class long, cell long, v array<double>")
    indexed = indexed.checkpoint(eager=True)
    held = np.zeros(kk * kk, dtype=np.int64)
    for r in indexed.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    total = int(held.sum())
    wanted = max(math.ceil(share * total), min(least, total))
    # blocks of cells: consecutive cells up to block_vectors; a larger cell gets blocks of its own
    first_block, parts, block, room = np.zeros(kk * kk, np.int64), np.ones(kk * kk, np.int64), 0, block_vectors
    for cell in np.flatnonzero(held):
        if held[cell] > room:
            block, room = block + 1, block_vectors
        first_block[cell], parts[cell] = block, max(1, math.ceil(held[cell] / block_vectors))
        block, room = block + parts[cell] - 1, room - held[cell] if parts[cell] == 1 else 0

    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id")).distinct()
    asked = members.join(asked, "vec_id").distinct()
    asked = asked.join(entries.select("h1", "h2", "class", "v"), ["h1", "h2"]).select("vec_id", "class", "v")
    asked = asked.checkpoint(eager=True)
    points = asked.dropDuplicates(["class"]).select("class", "v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            spot = first_block[t["cell"]] + t["class"].to_numpy().astype(np.uint64) % parts[t["cell"]].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int64)), *batch.columns],
                                             names=["block", "class", "cell", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                vs = part.column(1).to_pylist()
                _, a, b = _halves(vs, half)
                d1, d2 = -(a @ books[0].T), -(b @ books[1].T)
                out = {"block": [], "class": [], "cells": [], "v": []}
                for i, own in enumerate(part.column(0).to_pylist()):
                    by_block: dict[int, list[int]] = {}
                    for cell in nearest_cells(d1[i], d2[i], held, wanted):
                        for p in range(parts[cell]):
                            by_block.setdefault(int(first_block[cell]) + p, []).append(cell)
                    for blk, cells in by_block.items():
                        out["block"].append(blk)
                        out["class"].append(own)
                        out["cells"].append(cells)
                        out["v"].append(vs[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["block"], pa.int64()), pa.array(out["class"], pa.int64()),
                     pa.array(out["cells"], pa.list_(pa.int64())), pa.array(out["v"], pa.list_(pa.float64()))],
                    names=["block", "class", "cells", "v"])

    def rerank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = {"query": [], "class": [], "score": []}
        if len(left) and len(right):
            x = np.array(left["v"].tolist(), dtype=float)
            ids = left["class"].to_numpy()
            cells, slot = np.unique(left["cell"].to_numpy(), return_inverse=True)
            for lo in range(0, len(right), 256):
                part = right.iloc[lo : lo + 256]
                q = np.array(part["v"].tolist(), dtype=float)
                open_ = np.zeros((len(part), len(cells)), dtype=bool)
                for i, c in enumerate(part["cells"]):
                    open_[i, np.searchsorted(cells, np.intersect1d(c, cells))] = True
                rough = np.where(open_[:, slot], q @ x.T, -np.inf)
                cut = min(depth, rough.shape[1])
                floor = -np.partition(-rough, cut - 1, axis=1)[:, cut - 1]
                for i, own in enumerate(part["class"]):
                    near = np.flatnonzero((rough[i] >= floor[i] - 1e-9 * (1 + abs(floor[i]))) & np.isfinite(rough[i])
                                          if np.isfinite(floor[i]) else np.isfinite(rough[i]))
                    exact = (x[near] * q[i]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:depth]
                    cols["query"].append(np.full(len(best), own))
                    cols["class"].append(ids[near][best])
                    cols["score"].append(exact[best])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64 if c != "score" else float)
                             for c, v in cols.items()})

    blocks = max(1, math.ceil(points.count() / block_queries))
    left = indexed.mapInArrow(place, "block long, class long, cell long, v array<double>")
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = points.mapInArrow(visit, "block long, class long, cells array<long>, v array<double>")
    right = right.withColumn("turn", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
    found = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(
        rerank, "query long, class long, score double")
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "class")
    found = found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= depth).drop("r")
    rows = found.join(entries.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    rows = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= depth)
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("list"))
    out = asked.select("vec_id", "class").join(lists, F.col("class") == F.col("query")).select(
        F.col("vec_id").alias("query_id"),
        F.slice(F.filter("list", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("list"))
    return out.select("query_id", F.posexplode("list").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"),
        F.col("x.score").alias("score"))
