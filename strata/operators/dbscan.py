"""Exact DBSCAN on a sparse precomputed similarity table.

Semantics (those of DBSCAN with ``metric="precomputed"`` on ``1 - sim``):

* ``j`` is a neighbour of ``i`` when ``dist(i, j) <= eps``, both rounded alike (:func:`within`).  A point is its own
  neighbour only when its *own* distance ``1 - sim(i, i)`` qualifies
  (``self_neighbor="distance"``, the default); ``"always"`` counts every point;
* core points have at least ``min_samples`` neighbours;
* clusters are the connected components of core points, labelled by their
  lowest core id;
* a border point (not core, next to a core) joins the adjacent cluster with the
  lowest label, i.e. the cluster discovered first when points are scanned in
  ascending id order;
* everything else is noise.

Absent pairs have distance 1, so for ``eps < 1`` the sparse table is exact; for
``eps >= 1`` every pair of nodes is a neighbour and the answer is one cluster (if
there are at least ``min_samples`` nodes) or all noise, computed without pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import DISTANCE_DECIMALS, distance, within
from ..session import cut
from .components import connected_components

SELF_NEIGHBOR_MODES = ("distance", "always")


@dataclass
class DbscanResult:
    """``labels(node, label, core)`` for nodes in a cluster (noise absent).

    ``n_core`` is known only in the ``eps >= 1`` case; otherwise -1 (not counted).
    """

    labels: DataFrame
    n_core: int
    trivial: bool = False  # every cluster is a single node: nothing merges


def neighbours(sim: DataFrame, eps: float, self_neighbor: str = "distance", nodes: DataFrame | None = None) -> DataFrame:
    """``(i, j)`` pairs within ``eps`` (both orientations, self rows as the mode says)."""
    if self_neighbor not in SELF_NEIGHBOR_MODES:
        raise ValueError(f"self_neighbor must be one of {SELF_NEIGHBOR_MODES}")
    nb = sim.where(within(F.col("sim"), eps)).select("i", "j")
    if self_neighbor == "always":
        if nodes is None:
            raise ValueError("self_neighbor='always' needs the node table")
        nb = nb.where(F.col("i") != F.col("j")).unionByName(
            nodes.select(F.col("node").alias("i"), F.col("node").alias("j"))
        )
    return nb


def neighbour_counts(nb: DataFrame, min_samples: int) -> DataFrame:
    """``(node, n_neighbours, core)`` for nodes with at least one neighbour."""
    return nb.groupBy(F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("n_neighbours")).withColumn(
        "core", F.col("n_neighbours") >= F.lit(int(min_samples))
    )


def adjacent_groups(links: DataFrame, eps: float) -> DataFrame:
    """``(gi, gj)`` pairs of duplicate groups within ``eps``, both orientations (``links`` lists each once)."""
    return links.where(within(F.col("sim"), eps)).select(
        F.explode(F.array(F.struct(F.col("i").alias("gi"), F.col("j").alias("gj")),
                          F.struct(F.col("j").alias("gi"), F.col("i").alias("gj")))).alias("p")).select("p.*")


def listed_pairs(nb: DataFrame, groups: DataFrame, adjacent: DataFrame | None) -> DataFrame:
    """The pairs ``(i, j)`` of ``nb`` that neither a group of several members nor an adjacency of groups covers."""
    out = nb.join(groups.select(F.col("node").alias("i"), F.col("g").alias("gi"), F.col("m").alias("mi")), "i", "left")
    out = out.join(groups.select(F.col("node").alias("j"), F.col("g").alias("gj")), "j", "left")
    out = out.where(~F.coalesce((F.col("gi") == F.col("gj")) & (F.col("mi") >= 2), F.lit(False)))
    if adjacent is not None:
        out = out.join(adjacent, ["gi", "gj"], "left_anti")
    return out.select("i", "j")


def group_neighbours(groups: DataFrame, adjacent: DataFrame | None) -> DataFrame:
    """``(node, m)``: neighbours of a node that its group (of two or more) and the adjacent groups account for.

    A group counts with its number of members, so the work is that of the pairs of groups, not of members.
    """
    own = F.when(F.col("m") >= 2, F.col("m")).otherwise(F.lit(0))
    if adjacent is None:
        return groups.where(F.col("m") >= 2).select("node", own.alias("m"))
    sizes = groups.where(F.col("node") == F.col("g")).select(F.col("g").alias("gj"), "m")
    across = adjacent.join(sizes, "gj").groupBy(F.col("gi").alias("g")).agg(F.sum("m").alias("c"))
    total = own + F.coalesce("c", F.lit(0))
    return groups.join(across, "g", "left").where(total > 0).select("node", total.alias("m"))


def neighbour_counts_cliques(sim: DataFrame, eps: float, cliques: DataFrame | None,
                             self_neighbor: str = "distance", links: DataFrame | None = None) -> DataFrame:
    """A6 with duplicate groups: ``(node, n_neighbours)`` for nodes with a neighbour.

    A member counts its whole group (itself included), the members of the groups that ``links`` puts
    within ``eps`` of it, and the listed pairs that neither covers.
    """
    nb = neighbours(sim, eps, self_neighbor)
    if cliques is None:
        return nb.groupBy(F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("n_neighbours"))
    adjacent = None if links is None else adjacent_groups(links, eps)
    ex = listed_pairs(nb, cliques, adjacent).groupBy(F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("c"))
    return ex.join(group_neighbours(cliques, adjacent), "node", "full").select(
        "node", (F.coalesce(F.col("c"), F.lit(0)) + F.coalesce(F.col("m"), F.lit(0))).alias("n_neighbours")
    )


def neighbour_stats(nb: DataFrame, min_samples: int) -> DataFrame:
    """``(node, core, has_other)``: core flag and whether a neighbour other than itself exists."""
    return nb.groupBy(F.col("i").alias("node")).agg(
        (F.count(F.lit(1)) >= F.lit(int(min_samples))).alias("core"),
        F.max((F.col("i") != F.col("j")).cast("int")).alias("has_other"),
    )


def merge_radius(
    sim: DataFrame,
    min_samples: int,
    self_neighbor: str = "distance",
    cliques: DataFrame | None = None,
    clique_eps: float = 0.0,
    links: DataFrame | None = None,
) -> float:
    """The smallest radius at which :func:`dbscan` puts two nodes into one cluster (infinite if no listed pair does).

    A node merges with another from the radius on at which it is core and has a neighbour other than itself:
    the larger of its ``min_samples``-th smallest distance and its smallest one to another node.  The
    answer is the least of these, one aggregate over the table; every smaller radius needs no job.
    Only the first few rows of a node count, so a partial limit per node comes before the shuffle.

    ``cliques(node, g, m)`` are complete neighbourhoods from radius ``clique_eps`` on: there a member has ``m``
    neighbours at once and its listed pairs inside the group don't count; below they do.  Neighbourhoods
    only grow with the radius, so the first radius of either kind is the first of all.

    ``links(i, j, sim)`` between duplicate groups change nothing below their smallest distance.  From there on
    the answer is that distance: no step below it merges, one at or above it may or may not.
    """
    if links is not None:
        nearest = links.agg(F.min(distance(F.col("sim")))).first()[0]
        found = merge_radius(sim, min_samples, self_neighbor, cliques, clique_eps)
        return found if nearest is None else min(found, max(float(nearest), round(clique_eps, DISTANCE_DECIMALS)))
    if self_neighbor not in SELF_NEIGHBOR_MODES:
        raise ValueError(f"self_neighbor must be one of {SELF_NEIGHBOR_MODES}")
    k = max(1, int(min_samples))
    rows = sim.select("i", "j", distance(F.col("sim")).alias("d"))
    always = self_neighbor == "always"
    if always:  # every node is its own neighbour at distance 0: one fewer to find
        rows = rows.where("i != j")

    def least(rows: DataFrame, groups: DataFrame | None) -> float:
        first = Window.partitionBy("i").orderBy("d")
        few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= max(k, 2))
        size = F.lit(0)
        if groups is not None:
            few = few.join(groups.select(F.col("node").alias("i"), "m"), "i", "full")
            size = F.coalesce("m", F.lit(0))
        # the group counts the node itself
        need = F.lit(k) - (F.when(size > 0, size).otherwise(1) if always else size)
        node = few.groupBy("i").agg(
            F.max(need).alias("need"), F.max(size).alias("m"),
            F.min(F.when(F.col("nth") >= need, F.col("d"))).alias("core"),
            F.min(F.when(F.col("i") != F.col("j"), F.col("d"))).alias("other"))
        core = F.when(F.col("need") <= 0, F.lit(0.0)).otherwise(F.col("core"))
        other = F.when(F.col("m") >= 2, F.lit(0.0)).otherwise(F.col("other"))
        from_ = F.when(core.isNotNull() & other.isNotNull(), F.greatest(core, other))
        found = node.agg(F.min(from_)).first()[0]
        return float("inf") if found is None else float(found)

    if cliques is None:
        return least(rows, None)
    clique_eps = round(clique_eps, DISTANCE_DECIMALS)
    if clique_eps > 0:
        listed = least(rows, None)
        if listed < clique_eps:
            return listed
    groups = cliques.where(F.col("m") >= 2).select("node", "g", "m")
    across = (
        rows.join(groups.select(F.col("node").alias("i"), F.col("g").alias("gi")), "i", "left")
        .join(groups.select(F.col("node").alias("j"), F.col("g").alias("gj")), "j", "left")
        .where(F.col("gi").isNull() | F.col("gj").isNull() | (F.col("gi") != F.col("gj")))
        .select("i", "j", "d")
    )
    return max(least(across, groups), clique_eps)


def dbscan(
    sim: DataFrame,
    nodes: DataFrame,
    eps: float,
    min_samples: int,
    self_neighbor: str = "distance",
    cliques: DataFrame | None = None,
    merges: bool = False,
    links: DataFrame | None = None,
) -> DbscanResult:
    """Cluster the ``nodes`` table ``(node)`` given ``sim(i, j, sim)``.

    ``cliques(node, g, m)``: groups known to be complete neighbourhoods at this
    radius (every pair inside, self pairs included, is within ``eps``).  Their
    pairs are not listed: a member counts ``m`` neighbours from its group, core
    members are linked through the group's smallest core member, and a non-core
    member borders that member's cluster.  Explicit pairs inside a group are
    ignored (the group already covers them).

    ``links(i, j, sim)``, ``i < j``, are pairs of groups by their smallest members (a node without a
    duplicate is a group of one): within ``eps`` every member of one is a neighbour of every member of the
    other.  A group counts with its multiplicity and is linked, or bordered, through its smallest core
    member, so rows grow with the pairs of groups, whatever their sizes.

    Returns labels of clustered nodes only; a node absent from the result is noise.
    One job decides whether any core point has a neighbour other than itself;
    when none has, every cluster is a single point and nothing else runs.  ``merges`` says that one
    is known to have (:func:`merge_radius`), which saves that job.
    """
    min_samples = int(min_samples)
    if eps >= 1.0:
        n = nodes.count()
        if n >= min_samples and n > 0:
            low = nodes.agg(F.min("node")).first()[0]
            labels = nodes.select("node", F.lit(low).cast("bigint").alias("label"), F.lit(True).alias("core"))
            return DbscanResult(labels, n)
        return DbscanResult(nodes.select("node", F.lit(None).cast("bigint").alias("label"),
                                         F.lit(True).alias("core")).where(F.lit(False)), 0)
    nb = neighbours(sim, eps, self_neighbor, nodes)
    cl = adjacent = None
    if cliques is not None:
        cl = cliques.select("node", "g", "m") if links is not None else cliques.where(F.col("m") >= 2).select("node", "g", "m")
        adjacent = None if links is None else adjacent_groups(links, eps)
        nb = listed_pairs(nb, cl, adjacent)
        ex = nb.groupBy(F.col("i").alias("node")).agg(
            F.count(F.lit(1)).alias("c"), F.max((F.col("i") != F.col("j")).cast("int")).alias("o")
        )
        # whoever counts members of groups has a neighbour other than itself
        stats = ex.join(group_neighbours(cl, adjacent), "node", "full").select(
            "node",
            ((F.coalesce(F.col("c"), F.lit(0)) + F.coalesce(F.col("m"), F.lit(0))) >= F.lit(min_samples)).alias("core"),
            F.greatest(F.coalesce(F.col("o"), F.lit(0)), F.col("m").isNotNull().cast("int")).alias("has_other"),
        )
    else:
        stats = neighbour_stats(nb, min_samples)
    core = stats.where("core").select("node")
    if not merges and stats.where(F.col("core") & (F.col("has_other") == 1)).limit(1).count() == 0:
        # only isolated cores (if any): every cluster is a single node
        labels = core.select("node", F.col("node").alias("label"), F.lit(True).alias("core"))
        return DbscanResult(labels, -1, trivial=True)
    core = cut(core)
    ci = core.select(F.col("node").alias("i"))
    cj = core.select(F.col("node").alias("j"))
    core_edges = nb.where(F.col("i") < F.col("j")).join(ci, "i", "left_semi").join(cj, "j", "left_semi")
    hubs = None
    if cl is not None:
        # each core member of a clique links to the clique's smallest core member
        cmem = cl.join(core, "node", "left_semi")
        hubs = cut(cmem.groupBy("g").agg(F.min("node").alias("hub")))
        star = cmem.join(hubs, "g").where(F.col("node") != F.col("hub")).select(
            F.col("hub").alias("i"), F.col("node").alias("j")
        )
        core_edges = core_edges.unionByName(star)
        if adjacent is not None:
            ends = adjacent.where(F.col("gi") < F.col("gj"))
            ends = ends.join(hubs.select(F.col("g").alias("gi"), F.col("hub").alias("i")), "gi")
            ends = ends.join(hubs.select(F.col("g").alias("gj"), F.col("hub").alias("j")), "gj")
            core_edges = core_edges.unionByName(ends.select("i", "j"))
    cc = connected_components(core_edges, "i", "j")
    core_labels = cut(
        core.join(cc, "node", "left").select(
            "node", F.coalesce(F.col("label"), F.col("node")).alias("label"), F.lit(True).alias("core")
        )
    )
    # Border points take the lowest label among adjacent cores
    border = (
        nb.where(F.col("i") != F.col("j"))
        .join(ci.withColumnRenamed("i", "node"), F.col("i") == F.col("node"), "left_anti")
        .join(core_labels.select(F.col("node").alias("j"), "label"), "j")
        .select(F.col("i").alias("node"), "label")
    )
    if cl is not None:
        reached = hubs.join(core_labels.select(F.col("node").alias("hub"), "label"), "hub").select("g", "label")
        if adjacent is not None:  # the lowest label among a group's own cores and those of adjacent groups
            across = adjacent.join(reached.withColumnRenamed("g", "gj"), "gj").select(F.col("gi").alias("g"), "label")
            reached = reached.unionByName(across).groupBy("g").agg(F.min("label").alias("label"))
        border = border.unionByName(cl.join(core, "node", "left_anti").join(reached, "g").select("node", "label"))
    border = border.groupBy("node").agg(F.min("label").alias("label")).select(
        "node", "label", F.lit(False).alias("core")
    )
    return DbscanResult(core_labels.unionByName(border), -1)


def dbscan_labels(
    sim: DataFrame,
    nodes: DataFrame,
    eps: float,
    min_samples: int,
    self_neighbor: str = "distance",
    noise: int | None = -1,
    cliques: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """C1/C6 user form: ``(node, label)`` for every node; label = min node id of the
    cluster, noise gets ``noise`` (``None`` keeps the node's own id, C3)."""
    res = dbscan(sim, nodes, eps, min_samples, self_neighbor, cliques, links=links)
    canon = res.labels.groupBy("label").agg(F.min("node").alias("cid"))
    lab = res.labels.join(canon, "label").select("node", "cid")
    fill = F.col("node") if noise is None else F.lit(int(noise)).cast("bigint")
    return nodes.select("node").join(lab, "node", "left").select(
        "node", F.coalesce(F.col("cid"), fill).alias("label")
    )
