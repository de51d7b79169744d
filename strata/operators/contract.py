"""A1-A3: contract features by a clustering.

Two forms of every contraction:

* from raw features and an assignment ``(idx, cid)`` (what a user calls);
* incrementally, from already contracted features and ``moves(node, new)``
  listing only the clusters that changed (what the layer loop calls).  Sums
  compose, so contracting the previous layer's state equals contracting the raw
  features by the new assignment, and the tables shrink layer after layer.

Moves are usually far fewer than rows; the joins against them are left joins on
one key each, by broadcast where the moves are few, so that the rows are not shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import join_bounded


def _relabel(df: DataFrame, col: str, moves: DataFrame) -> DataFrame:
    m = moves.select(F.col("node").alias(col), F.col("new").alias(f"_{col}_new"))
    return join_bounded(df, m, col, "left").withColumn(col, F.coalesce(F.col(f"_{col}_new"), F.col(col))).drop(f"_{col}_new")


def contract_edges(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """A1 ``C . X . C^T``: ``(src, dst, w)`` summed between clusters (diagonal kept)."""
    a = assign.select("idx", "cid")
    return (
        edges.join(a.select(F.col("idx").alias("src"), F.col("cid").alias("ci")), "src")
        .join(a.select(F.col("idx").alias("dst"), F.col("cid").alias("cj")), "dst")
        .groupBy(F.col("ci").alias("src"), F.col("cj").alias("dst"))
        .agg(F.sum("w").alias("w"))
    )


def contract_edges_by_moves(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """A1, incremental form."""
    e = _relabel(_relabel(edges, "src", moves), "dst", moves)
    return e.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def aggregate_vectors(vectors: DataFrame, assign: DataFrame, how: str = "mean") -> DataFrame:
    """A2 (``mean``) / A3 (``sum``): ``(node, term, x)`` per cluster.

    The mean divides by the number of members of the cluster that are in the
    vector table's support (``assign`` restricted to it), all-zero members
    included.
    """
    if how not in ("mean", "sum"):
        raise ValueError(f"cluster vectors are a mean or a sum, not {how!r}")
    a = assign.select(F.col("idx").alias("node"), "cid")
    sums = vectors.join(a, "node").groupBy("cid", "term").agg(F.sum("x").alias("x"))
    if how == "sum":
        return sums.select(F.col("cid").alias("node"), "term", "x")
    counts = a.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(counts, "cid").select(
        F.col("cid").alias("node"), "term", (F.col("x") / F.col("n")).alias("x")
    )


def contract_vectors_by_moves(vectors: DataFrame, counts: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2/A3 incremental form on summed vectors and member counts ``(node, n)``."""
    v = _relabel(vectors, "node", moves).groupBy("node", "term").agg(F.sum("x").alias("x"))
    c = _relabel(counts, "node", moves).groupBy("node").agg(F.sum("n").alias("n"))
    return v, c
