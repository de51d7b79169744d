"""Exact cosine similarity join above a floor, by prefix filtering.

All-pairs cosine emits every pair of nodes that share any term, which explodes on
frequent terms.  When only pairs with ``cos >= tau`` matter (a DBSCAN ladder whose
largest radius is ``eps`` needs ``tau = 1 - eps``) the candidates can be pruned
exactly (Bayardo, Ma, Srikant: "Scaling up all pairs similarity search", 2007):

* terms are ordered globally, rarest first (document frequency, then the term);
* for each unit vector and position ``p`` in that order, ``bound(p)`` bounds the
  dot product of the vector's terms from ``p`` on with *any* unit vector: the
  smaller of the suffix norm (Cauchy-Schwarz) and ``sum u(t) * maxw(t)`` where
  ``maxw(t)`` is the largest weight of ``t`` in any vector;
* the *prefix* keeps the positions with ``bound >= tau``, the rest is the
  *suffix*; if ``cos(a, b) >= tau`` the first common term (global order) lies in
  both prefixes, so candidates are pairs sharing a prefix term;
* the exact dot product is assembled without re-reading whole vectors: shared
  prefix-prefix terms come from the candidate join itself, and the remaining
  shared terms lie in a (short) suffix, found by expanding candidates with the
  suffix rows of either side:
  ``dot = P(a)&P(b) + S(a)&V(b) + P(a)&S(b)`` (each shared term exactly once).

Requires non-negative weights (term weights are); otherwise falls back to the
full join and a filter.

Frequent terms that weigh much stay in the prefixes, and then the candidate join lists most pairs of nodes, many of
them several times.  The rows it would list are counted first; where they are many for the pairs there are, the
nodes are joined by blocks (:mod:`strata.functions.blocks`), with the same pairs as result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairs import pairs_sharing_key
from ..session import cut
from .blocks import cosine_by_blocks
from .similarity import _mirror, cosine_similarity, normalise

# Slack for float rounding when comparing against the floor: pairs just below
# ``tau`` are kept, never lost.  Fixed value.
FLOOR_SLACK = 1e-9
# The candidate join may list so many rows; beyond that, at most this share of all pairs.
FEW_ROWS, MOST_PAIRS = 2_000_000, 0.05
# Vectors of more entries are judged by the prefixes of some of their nodes, of about so many entries.
JUDGED_ENTRIES = 2_000_000
# Given pairs are expanded term by term unless the join of all nodes by term lists at most so many times these rows.
TERM_GAIN = 2


def split_prefix(u: DataFrame, floor: float) -> DataFrame:
    """``(node, term, u, pre, r)``: ``pre`` marks the prefix positions of each vector,
    ``r`` is the norm of the vector from this term on (this term included)."""
    stats = u.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("u").alias("maxw"))
    # suffix sums (this term and all later ones, rarest first) as running sums over
    # the reversed order: a running frame is linear in the vector length, whereas a
    # frame ending at "unbounded following" is re-aggregated for every row
    w = Window.partitionBy("node").orderBy(F.col("df").desc(), F.col("term").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = u.join(stats, "term")
    rest = F.sqrt(F.sum(F.col("u") * F.col("u")).over(w))
    bound = F.least(rest, F.sum(F.col("u") * F.col("maxw")).over(w))
    return ranked.select("node", "term", "u", (bound >= F.lit(floor)).alias("pre"), rest.alias("r"))


def lists_most_pairs(pre: DataFrame, few_rows: int) -> bool:
    """Whether the join of the prefixes ``(k, node[, c])`` makes more than ``few_rows`` rows and many for the pairs there are."""
    chosen = F.col("c").cast("int") if "c" in pre.columns else F.lit(1)
    n = lambda df, *key: df.groupBy(*key).agg(F.sum(chosen).cast("double").alias("a"), F.count(F.lit(1)).alias("b"))
    listed = n(pre, "k").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0
    if listed <= few_rows:
        return False
    nodes = n(pre.drop("k", "v", "r").distinct()).first()
    return listed > MOST_PAIRS * nodes["a"] * nodes["b"]


def likely_lists_most_pairs(u: DataFrame, floor: float, few_rows: int, chosen: DataFrame | None = None,
                            judged: int = JUDGED_ENTRIES) -> bool:
    """:func:`lists_most_pairs` as estimated from every so-manieth node, where there are more than ``judged`` entries.

    It only chooses between two exact joins, before prefixes of all vectors are made and stored for one of them.
    """
    m = u.count() // judged
    if m < 2:
        return False
    some = cut(u.where(F.pmod(F.xxhash64("node"), F.lit(m)) == 0))
    pre = cut(split_prefix(some, floor)).where("pre").select(F.col("term").alias("k"), "node")
    if chosen is not None:
        pre = pre.join(chosen, "node", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    one = F.col("c").cast("double") if chosen is not None else F.lit(1.0)
    n = pre.groupBy("k").agg(F.sum(one).alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    # of the pairs of different nodes one in m * m is seen, of the nodes one in m
    listed = n.agg(F.sum(F.col("a") * (F.col("b") - 1)) * m * m + F.sum("a") * m).first()[0] or 0.0
    if listed <= few_rows:
        return False
    nodes = pre.drop("k").distinct().agg(F.sum(one).alias("a"), F.count(F.lit(1)).alias("b")).first()
    return listed > MOST_PAIRS * nodes["a"] * nodes["b"] * m * m


def cosine_at_least(vectors: DataFrame, tau: float, salt_threshold: int | None = None,
                    changed: DataFrame | None = None, few_rows: int = FEW_ROWS, enough: int | None = None) -> DataFrame:
    """Symmetric ``(i, j, sim)`` of all pairs with ``cos >= tau`` (diagonal included).

    ``enough``: the table serves DBSCAN at the radius ``1 - tau`` alone, with ``min_samples`` up to this; where the join
    is by blocks, pairs without which its clusters are the same are left out (:func:`cosine_by_blocks`).

    ``changed(node)`` restricts the result to pairs with at least one of these nodes; the candidate join
    then starts from their prefixes alone.

    ``vectors(node, term, x)`` should be materialised: it is read several times.
    Candidates sharing a prefix term are further filtered by the suffix-norm
    bound at their first shared term (``max r_i * r_j >= tau``: the dot product
    lives on terms from that one on).  Survivors are verified by the cheaper of
    two exact routes: expanding both (short) suffixes and adding the
    prefix-prefix part from the join, or expanding the shorter whole vector.
    """
    floor = tau - FLOOR_SLACK
    if floor <= 0 or vectors.where(F.col("x") < 0).limit(1).count() > 0:
        full = cosine_similarity(vectors, salt_threshold=salt_threshold)
        full = full if floor <= 0 else full.where(F.col("sim") >= floor)
        return full if changed is None else touching(full, changed)
    unit = normalise(vectors)
    mark = None if changed is None else changed.select("node").distinct().withColumn("c", F.lit(True))
    if likely_lists_most_pairs(unit, floor, few_rows, mark):
        return _mirror(cosine_by_blocks(unit, floor, changed, enough=enough, reach=1.0 - tau))
    parts = cut(split_prefix(unit, floor))
    pre = parts.where("pre").select(F.col("term").alias("k"), "node", F.col("u").alias("v"), "r")
    if mark is not None:
        pre = pre.join(mark, "node", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    if lists_most_pairs(pre, few_rows):
        return _mirror(cosine_by_blocks(parts, floor, changed, enough=enough, reach=1.0 - tau))
    suf = parts.where(~F.col("pre")).select("node", "term", "u")
    sizes = parts.groupBy("node").agg(
        F.count(F.lit(1)).alias("len"), F.sum((~F.col("pre")).cast("int")).alias("ns")
    )
    cand = (
        pairs_sharing_key(pre, combine=lambda a, b: a * b, salt_threshold=salt_threshold)
        .where(F.col("ub") >= F.lit(floor))
        .join(sizes.select(F.col("node").alias("i"), F.col("len").alias("li"), F.col("ns").alias("si")), "i")
        .join(sizes.select(F.col("node").alias("j"), F.col("len").alias("lj"), F.col("ns").alias("sj")), "j")
        .select("i", "j", F.col("s").alias("pp"),
                ((F.col("si") + F.col("sj")) <= F.least("li", "lj")).alias("by_suffix"))
    )
    cand = cut(cand)
    # route 1: prefix-prefix part from the join + shared terms in either suffix
    c1 = cand.where("by_suffix")
    sa = (
        c1.select("i", "j")
        .join(suf.select(F.col("node").alias("i"), "term", F.col("u").alias("ui")), "i")
        .join(parts.select(F.col("node").alias("j"), "term", F.col("u").alias("uj")), ["j", "term"])
        .select("i", "j", (F.col("ui") * F.col("uj")).alias("s"))
    )
    sb = (
        c1.select("i", "j")
        .join(suf.select(F.col("node").alias("j"), "term", F.col("u").alias("uj")), "j")
        .join(parts.where("pre").select(F.col("node").alias("i"), "term", F.col("u").alias("ui")), ["i", "term"])
        .select("i", "j", (F.col("ui") * F.col("uj")).alias("s"))
    )
    route1 = c1.select("i", "j", F.col("pp").alias("s")).unionByName(sa).unionByName(sb)
    # route 2: the shorter whole vector of the pair, looked up in the other
    route2 = cosine_for_pairs(parts.select("node", "term", F.col("u").alias("x")),
                              cand.where(~F.col("by_suffix")), normalised=True)
    total = (
        route1.groupBy("i", "j").agg(F.sum("s").alias("sim"))
        .unionByName(route2)
        .where(F.col("sim") >= F.lit(floor))
    )
    return _mirror(total)


def touching(sim: DataFrame, nodes: DataFrame, inverse: bool = False) -> DataFrame:
    """The pairs with an end in ``nodes(node)``, or those without."""
    ends = nodes.select("node").distinct().withColumn("_in", F.lit(True))
    tagged = sim.join(ends.withColumnRenamed("node", "i").withColumnRenamed("_in", "_i"), "i", "left").join(
        ends.withColumnRenamed("node", "j").withColumnRenamed("_in", "_j"), "j", "left")
    hit = F.coalesce("_i", "_j", F.lit(False))
    return tagged.where(~hit if inverse else hit).select("i", "j", "sim")


def cosine_for_pairs(vectors: DataFrame, pairs: DataFrame, normalised: bool = False,
                     term_gain: float = TERM_GAIN, few_rows: int = FEW_ROWS) -> DataFrame:
    """Exact cosine of the given pairs ``(i, j)`` with ``i <= j``, the half matrix
    ``(i, j, sim)`` (zero similarities dropped).

    Each pair is expanded with the terms of its shorter vector and looked up in the other.  Where the pairs are
    most of those that share terms, that would shuffle a vector once per pair; then the vectors are joined by term,
    each shuffled once, and the products of a pair are added up before they leave their task.  ``pairs`` should be
    materialised, it is read twice."""
    u = vectors.withColumnRenamed("x", "u") if normalised else normalise(vectors)
    lens = u.groupBy("node").agg(F.count(F.lit(1)).alias("len"))
    p = (
        pairs.select("i", "j")
        .join(lens.select(F.col("node").alias("i"), F.col("len").alias("li")), "i")
        .join(lens.select(F.col("node").alias("j"), F.col("len").alias("lj")), "j")
        .select(
            "i",
            "j",
            F.when(F.col("li") <= F.col("lj"), F.col("i")).otherwise(F.col("j")).alias("probe"),
            F.when(F.col("li") <= F.col("lj"), F.col("j")).otherwise(F.col("i")).alias("other"),
            F.least("li", "lj").cast("double").alias("rows"),
        )
    )
    expanded = p.agg(F.sum("rows")).first()[0] or 0.0
    if expanded > few_rows:
        n = u.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n"))
        listed = n.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
        if listed <= term_gain * expanded:
            rows = u.select("node", F.col("term").alias("k"), F.col("u").alias("v"))
            every = pairs_sharing_key(rows, combine=lambda a, b: a * b)
            return every.join(pairs.select("i", "j"), ["i", "j"]).select("i", "j", F.col("s").alias("sim")).where(
                F.col("sim") != 0)
    return (
        p.drop("rows")
        .join(u.select(F.col("node").alias("probe"), "term", F.col("u").alias("up")), "probe")
        .join(u.select(F.col("node").alias("other"), "term", F.col("u").alias("uo")), ["other", "term"])
        .groupBy("i", "j")
        .agg(F.sum(F.col("up") * F.col("uo")).alias("sim"))
        .where(F.col("sim") != 0)
    )
