"""Pairwise similarities as sparse joins over long tables.

Conventions used across the package:

* edges   ``(src BIGINT, dst BIGINT, w DOUBLE)``: directed weights, one row per pair;
* vectors ``(node BIGINT, term STRING, x DOUBLE)``: sparse feature vectors;
* sim     ``(i BIGINT, j BIGINT, sim DOUBLE)``: symmetric, both orientations and the
  diagonal ``(i, i)`` present, zero similarities absent.

Absent pairs have similarity 0, i.e. distance 1, so for every radius below 1 the
sparse table is exact (a dense matrix is never built).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairs import join_bounded, pairs_sharing_key
from ..session import cut

# Distances are rounded before ``<= eps`` so that float noise of different sum
# orders (Spark vs. an SQL oracle, or partial vs. final aggregation) cannot move a
# pair across a radius.  Fixed value shared by engine and oracle.
DISTANCE_DECIMALS = 12
# Slack of size bounds against float rounding: pairs at a bound are kept.  Fixed value.
SIZE_SLACK = 1e-9
# A node with more callers than this is not ordered as one window but by counts per degree and hash bucket.
HOT_CALLERS = 1_000_000
# Prefixes are joined only where that lists fewer pairs than a join of all callers by more than this factor: every
# pair that they list is counted in full afterwards, a row for each caller of the smaller set.
PREFIX_GAIN = 8
CALLER_BUCKETS = 1024


def distance(sim: Column) -> Column:
    """``max(0, 1 - sim)`` rounded to :data:`DISTANCE_DECIMALS`."""
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - sim), DISTANCE_DECIMALS)


def within(sim: Column, reach: float) -> Column:
    """The one radius test: the rounded distance is at most ``reach``, rounded alike.

    A table cut at ``reach`` keeps every pair that the neighbour test passes at any radius up to it.
    """
    return distance(sim) <= F.lit(round(float(reach), DISTANCE_DECIMALS))


def _mirror(half: DataFrame) -> DataFrame:
    """Half matrix ``i <= j`` -> both orientations (diagonal once)."""
    return half.select(
        F.explode(
            F.when(
                F.col("i") == F.col("j"),
                F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("i").alias("i"), F.col("j").alias("j")),
                    F.struct(F.col("j").alias("i"), F.col("i").alias("j")),
                )
            )
        ).alias("p"),
        "sim",
    ).select("p.i", "p.j", "sim")


def incoming(edges: DataFrame) -> DataFrame:
    """A5: incoming weight per node, ``(node, w_in)``."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("w_in"))


def call_similarity(edges: DataFrame) -> DataFrame:
    """M1: ``sim[i,j] = (X[i,j]/in[j] + X[j,i]/in[i]) / ([in[i]!=0] + [in[j]!=0])``.

    ``in`` is the column sum (incoming weight).  A term whose incoming weight is 0
    contributes 0 and 0/0 is 0.  The diagonal is ``X[i,i]/in[i]`` (not 1).
    """
    e = edges.where(F.col("w") != 0).select("src", "dst", "w")
    inc = incoming(e)
    flagged = e.join(
        inc.select(F.col("node").alias("dst"), F.col("w_in").alias("in_dst")), "dst"
    ).join(
        inc.select(F.col("node").alias("src"), F.col("w_in").alias("in_src")), "src", "left"
    )
    v = F.when(F.col("in_dst") != 0, F.col("w") / F.col("in_dst")).otherwise(F.lit(0.0))
    f_src = (F.coalesce(F.col("in_src"), F.lit(0.0)) != 0).cast("int")
    f_dst = (F.col("in_dst") != 0).cast("int")
    # each edge contributes to (src,dst) and to (dst,src); a self-edge twice to (i,i)
    both = flagged.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("i"), F.col("dst").alias("j"), v.alias("v"),
                         f_src.alias("fi"), f_dst.alias("fj")),
                F.struct(F.col("dst").alias("i"), F.col("src").alias("j"), v.alias("v"),
                         f_dst.alias("fi"), f_src.alias("fj")),
            )
        ).alias("p")
    ).select("p.*")
    agg = both.groupBy("i", "j").agg(
        F.sum("v").alias("s"), F.max("fi").alias("fi"), F.max("fj").alias("fj")
    )
    den = F.col("fi") + F.col("fj")
    return agg.select(
        "i", "j", F.when(den > 0, F.col("s") / den).otherwise(F.lit(0.0)).alias("sim")
    ).where(F.col("sim") != 0)


def _caller_prefixes(rows: DataFrame, n: DataFrame, first: Column, hot_callers: int) -> DataFrame:
    """The rows ``(k, node, deg, n)`` among the ``first`` ones of their node in the order of ``deg``, ties by a hash.

    A node with more than ``hot_callers`` callers is not sorted by one task: its callers are counted by degree and
    hash bucket, only these counts are ordered, and the buckets that begin within the prefix are taken
    whole.  That is the prefix or a little more, in an order common to all nodes, so no pair is lost.
    """
    bucket = F.pmod(F.xxhash64("k"), F.lit(CALLER_BUCKETS))
    rows = rows.withColumn("bucket", bucket)
    order = ["deg", "bucket"]
    at = F.row_number().over(Window.partitionBy("node").orderBy(*order, "k"))
    if n.where(F.col("n") > hot_callers).limit(1).count() == 0:
        return rows.withColumn("at", at).where(F.col("at") <= first)
    plain = rows.where(F.col("n") <= hot_callers).withColumn("at", at).where(F.col("at") <= first)
    hot = rows.where(F.col("n") > hot_callers)
    before = Window.partitionBy("node").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = hot.groupBy("node", "n", *order).agg(F.count(F.lit(1)).alias("some"))
    taken = counts.withColumn("at", F.coalesce(F.sum("some").over(before), F.lit(0)) + 1).where(F.col("at") <= first)
    of_hot = hot.join(taken.select("node", *order, "at"), ["node", *order])
    return plain.unionByName(of_hot)


def _listed(rows: DataFrame) -> float:
    """How many pairs a self-join of ``rows`` on ``k`` lists."""
    some = rows.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return some.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0


def cousage_similarity(edges: DataFrame, salt_threshold: int | None = None, reach: float = 1.0,
                       hot_callers: int = HOT_CALLERS) -> DataFrame:
    """M2: Jaccard similarity of the sets of callers (non-zero column pattern).

    ``|C(i) & C(j)| / |C(i) | C(j)|``; the diagonal is 1 for every node with at
    least one caller.  Intersections come from a self-join on the caller, salted
    for hub callers so no task holds a hot caller's pair list alone.

    With a ``reach`` below 1 only pairs of similarity ``t = 1 - reach`` or more are needed.  Two such
    sets of sizes n and m share a caller among the first ``n - ceil(t n) + 1`` and ``m - ceil(t m) + 1``
    of either in any common order; callers are ordered by how many nodes they call, so hubs
    come last and hardly enter the join.  The pairs found are then counted in full.  Where the prefixes are most of
    the sets (a small ``t``, or callers of like degree) all callers are joined, which counts the pairs at once.
    """
    nz = edges.where(F.col("w") != 0).select(F.col("src").alias("k"), F.col("dst").alias("node")).distinct()
    n = nz.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    t = 1.0 - reach
    pre = None
    if t > SIZE_SLACK:
        degree = nz.groupBy("k").agg(F.count(F.lit(1)).alias("deg"))
        rows = nz.join(degree, "k").join(n, "node")
        first = F.col("n") - F.ceil(F.col("n") * F.lit(t) - F.lit(SIZE_SLACK)) + 1
        pre = _caller_prefixes(rows, n, first, hot_callers).select("k", "node", F.lit(1.0).alias("v"))
        if _listed(nz) <= PREFIX_GAIN * _listed(pre):
            pre = None
    if pre is None:
        inter = pairs_sharing_key(nz.withColumn("v", F.lit(1.0)), salt_threshold=salt_threshold,
                                  combine=lambda a, b: F.lit(1.0))
    else:
        some = pairs_sharing_key(pre, salt_threshold=salt_threshold, combine=lambda a, b: F.lit(1.0)).select("i", "j")
        some = some.join(n.select(F.col("node").alias("i"), F.col("n").alias("ni")), "i").join(
            n.select(F.col("node").alias("j"), F.col("n").alias("nj")), "j")
        some = some.where(F.least("ni", "nj") >= F.greatest("ni", "nj") * F.lit(t) - F.lit(SIZE_SLACK)).select(
            "i", "j", (F.col("ni") <= F.col("nj")).alias("small_i"))
        probe = some.select("i", "j", F.when(F.col("small_i"), F.col("i")).otherwise(F.col("j")).alias("node"),
                            F.when(F.col("small_i"), F.col("j")).otherwise(F.col("i")).alias("other"))
        inter = probe.join(nz, "node").join(nz.withColumnRenamed("node", "other"), ["other", "k"]).groupBy("i", "j").agg(
            F.count(F.lit(1)).cast("double").alias("s"))
    half = inter.join(n.select(F.col("node").alias("i"), F.col("n").alias("ni")), "i").join(
        n.select(F.col("node").alias("j"), F.col("n").alias("nj")), "j"
    ).select(
        "i", "j", (F.col("s") / (F.col("ni") + F.col("nj") - F.col("s"))).alias("sim")
    )
    if t > SIZE_SLACK:
        half = half.where(within(F.col("sim"), reach))
    return _mirror(half)


def normalise(vectors: DataFrame) -> DataFrame:
    """A8 + scaling: unit vectors ``(node, term, u)``; zero vectors have no rows.

    The norms, a row per node, are sent to the vectors where they are few, so these are not shuffled."""
    v = vectors.where(F.col("x") != 0)
    norms = cut(v.groupBy("node").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))
    return join_bounded(v, norms, "node", "inner").select("node", "term", (F.col("x") / F.col("norm")).alias("u"))


def cosine_similarity(vectors: DataFrame, salt_threshold: int | None = None) -> DataFrame:
    """M3: cosine of sparse vectors; a zero vector has similarity 0, even to itself.

    Exact over all pairs sharing a term (half matrix via ``i <= j``).  For a
    similarity floor use :func:`strata.functions.prefix.cosine_at_least`, which
    prunes candidates exactly.
    """
    u = normalise(vectors).select("node", F.col("term").alias("k"), F.col("u").alias("v"))
    half = pairs_sharing_key(u, salt_threshold=salt_threshold,
                             combine=lambda a, b: a * b).withColumnRenamed("s", "sim")
    return _mirror(half.where(F.col("sim") != 0))


def combine_similarities(sims: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """M5 + P5: weighted sum (or mean) of several similarity tables, capped at 1.

    Alignment on ``(i, j)`` is a union + group-by; a pair missing from a child
    counts as 0 there.
    """
    if len(sims) < 2:
        raise ValueError("a combined similarity needs at least two children")
    if weights is None:
        weights = [1.0 / len(sims)] * len(sims)
    if len(weights) != len(sims):
        raise ValueError(f"{len(sims)} similarities need as many weights, not {len(weights)}")
    if abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError(f"weights must sum to 1, got {sum(weights)}")
    parts = [s.select("i", "j", (F.col("sim") * F.lit(float(w))).alias("sim")) for s, w in zip(sims, weights)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (
        u.groupBy("i", "j")
        .agg(F.least(F.sum("sim"), F.lit(1.0)).alias("sim"))
        .where(F.col("sim") != 0)
    )


SIMILARITIES = {"call": call_similarity, "cousage": cousage_similarity}


def edge_similarity(name: str):
    """M6: similarity by name; unknown names are rejected."""
    if name not in SIMILARITIES:
        raise ValueError(f"no edge similarity is called {name!r}; there are {sorted(SIMILARITIES)}")
    return SIMILARITIES[name]
