"""Analyses: what a layer step clusters on (O11 protocol and the built-in kinds).

An analysis owns features keyed by atom index and a *support* (the atoms it
knows).  During a decomposition it keeps its features contracted to the current
clusters and answers three questions:

* ``nodes()``       -- the clusters holding at least one supported atom;
* ``similarity()``  -- ``(i, j, sim)`` between those clusters;
* ``apply_moves()`` -- re-contract after a step merged clusters.

A user-defined analysis subclasses :class:`Analysis` and implements
``_seed_state``, ``_move_state`` and ``_compute_similarity`` with DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import duplicate_groups, representatives
from ..functions.prefix import FLOOR_SLACK, cosine_at_least, cosine_for_pairs, touching
from ..functions.similarity import (
    DISTANCE_DECIMALS, _mirror, combine_similarities, cosine_similarity, edge_similarity, within)
from ..operators.dbscan import merge_radius
from ..operators.contract import contract_edges, contract_edges_by_moves, contract_vectors_by_moves
from ..session import cut

AGGREGATIONS = ("mean", "sum")


class Analysis:
    """Base class.  ``support``: ``(idx)`` of supported atoms."""

    name = "analysis"

    def __init__(self) -> None:
        self._support: DataFrame | None = None
        self._nodes: DataFrame | None = None
        self._sim: DataFrame | None = None
        self._sim_reach: float | None = None
        # duplicate groups that are complete neighbourhoods from radius ``_clique_eps`` on
        self._cliques: DataFrame | None = None
        self._clique_eps: float = 0.0
        # pairs of those groups, by their smallest members, that stand for all pairs of their members
        self._links: DataFrame | None = None
        # first merging radius of the cached similarity, by (min_samples, self_neighbor)
        self._merge_radii: dict[tuple[int, str], float] = {}
        self.collapse_duplicates = True

    # -- protocol -------------------------------------------------------------
    def bind(self, atoms: DataFrame) -> None:
        """Resolve the support against the universe ``atoms(idx, ...)``."""
        raise NotImplementedError

    def _seed_state(self, assign: DataFrame) -> None:
        raise NotImplementedError

    def _move_state(self, moves: DataFrame) -> None:
        raise NotImplementedError

    def _compute_similarity(self, reach: float) -> DataFrame:
        """Pairs whose distance is at most ``reach`` (all non-zero pairs from radius 1 on)."""
        raise NotImplementedError

    # -- driver-facing ----------------------------------------------------------
    def bind_once(self, atoms: DataFrame) -> None:
        """:meth:`bind`, unless this very universe is bound already."""
        if getattr(self, "_universe", None) is not atoms:
            self.bind(atoms)
            self._universe = atoms

    @property
    def support(self) -> DataFrame:
        if self._support is None:
            raise RuntimeError("analysis is not bound to an atom universe")
        return self._support

    def seed(self, assign: DataFrame) -> None:
        """Contract raw features by ``assign(idx, cid)``; nodes = clusters of supported atoms."""
        self._nodes = cut(assign.join(self.support, "idx", "left_semi").select(F.col("cid").alias("node")).distinct())
        self._seed_state(assign)
        self._sim = None

    def apply_moves(self, moves: DataFrame) -> None:
        """Incremental contraction after a step: ``moves(node, new)`` (changed only)."""
        m = moves.select(F.col("node").alias("_old"), "new")
        self._nodes = cut(
            self._nodes.join(m, F.col("node") == F.col("_old"), "left")
            .select(F.coalesce(F.col("new"), F.col("node")).alias("node"))
            .distinct()
        )
        self._move_state(moves)
        self._sim = None

    def nodes(self) -> DataFrame:
        return self._nodes

    def cliques_at(self, eps: float) -> DataFrame | None:
        """Clique groups valid at radius ``eps`` for the similarity asked for last, or None."""
        if self._cliques is not None and round(eps, DISTANCE_DECIMALS) >= self._clique_eps:
            return self._cliques
        return None

    def links_at(self, eps: float) -> DataFrame | None:
        """``(i, j, sim)`` of pairs of duplicate groups that :meth:`similarity` does not list member by member, or None."""
        return self._links if self.cliques_at(eps) is not None else None

    def similarity(self, reach: float = 1.0) -> DataFrame:
        """Similarity of the pairs within ``reach`` at the current contraction.

        Where nodes share a vector, pairs inside a duplicate group (:meth:`cliques_at`) and pairs between
        two groups (:meth:`links_at`) are not listed here.

        Cached until the next merge (rule 1); a table made for a larger reach serves a smaller one,
        because the neighbour test is applied to it again at every step.
        """
        reach = min(float(reach), 1.0)
        if self._sim is None or self._sim_reach < reach:
            self._cliques = self._links = None
            self._sim = cut(self._compute_similarity(reach))
            self._sim_reach = reach
            self._merge_radii = {}
        return self._sim

    def next_merge(self, reach: float, min_samples: int, self_neighbor: str = "distance") -> float:
        """The smallest radius up to ``reach`` (below 1) at which a step on this contraction merges nodes, else infinite.

        Found once per similarity table, so the steps of a ladder below it run no job.
        """
        sim = self.similarity(reach)
        kind = (int(min_samples), self_neighbor)
        if kind not in self._merge_radii:
            self._merge_radii[kind] = merge_radius(sim, min_samples, self_neighbor, self._cliques, self._clique_eps,
                                                    self._links)
        return self._merge_radii[kind]

    def full_similarity(self) -> DataFrame:
        """Every non-zero pair, members of duplicate groups included: what a user's clusterer gets."""
        collapse, self.collapse_duplicates = self.collapse_duplicates, False
        try:
            return cut(self._compute_similarity(1.0))
        finally:
            self.collapse_duplicates = collapse


def _within(sim: DataFrame, reach: float) -> DataFrame:
    return sim.where(within(F.col("sim"), reach)) if reach < 1.0 else sim


def _support_from(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = None
    for c in cols:
        s = df.select(F.col(c).alias("idx"))
        out = s if out is None else out.unionByName(s)
    return out.distinct()


class CallAnalysis(Analysis):
    """Directed interaction counts: edges ``(src, dst, w)`` on atom indices.

    ``similarity``: ``call`` (M1) or ``cousage`` (M2).  Edges or support atoms
    outside the universe are dropped (P1).
    """

    name = "calls"

    def __init__(self, edges: DataFrame, support: DataFrame | None = None, similarity: str = "call",
                 salt_threshold: int | None = None) -> None:
        super().__init__()
        self._fn = edge_similarity(similarity)
        self.similarity_name = similarity
        self.raw_edges = edges.select(
            F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"),
            F.col("w").cast("double").alias("w"),
        )
        self.raw_support = support
        self.salt_threshold = salt_threshold
        self.edges: DataFrame | None = None

    def bind(self, atoms: DataFrame) -> None:
        universe = atoms.select("idx")
        sup = self.raw_support if self.raw_support is not None else _support_from(self.raw_edges, ["src", "dst"])
        self._support = cut(sup.select(F.col("idx").cast("bigint")).distinct().join(universe, "idx", "left_semi"))
        self._bound_edges = (
            self.raw_edges.join(self._support.select(F.col("idx").alias("src")), "src", "left_semi")
            .join(self._support.select(F.col("idx").alias("dst")), "dst", "left_semi")
            .groupBy("src", "dst").agg(F.sum("w").alias("w"))
            .where(F.col("w") != 0)
        )

    def _seed_state(self, assign: DataFrame) -> None:
        self.edges = cut(contract_edges(self._bound_edges, assign).where(F.col("w") != 0))

    def _move_state(self, moves: DataFrame) -> None:
        self.edges = cut(contract_edges_by_moves(self.edges, moves).where(F.col("w") != 0))

    def _compute_similarity(self, reach: float) -> DataFrame:
        if self.similarity_name == "cousage":
            sim = self._fn(self.edges, salt_threshold=self.salt_threshold, reach=reach)
        else:
            sim = self._fn(self.edges)
        return _within(sim, reach)


class TermAnalysis(Analysis):
    """Term weights ``(idx, term, x)`` (e.g. TF-IDF); cosine similarity (M3).

    Clusters aggregate member vectors by ``mean`` (A2) or ``sum`` (A3).  Cosine
    ignores scale, so the state keeps sums and member counts and the similarity
    of means equals that of sums; :meth:`aggregated` returns either form.  A
    support atom outside the universe is an error (P2).
    """

    name = "terms"

    def __init__(self, vectors: DataFrame, support: DataFrame | None = None, aggregation: str = "mean",
                 salt_threshold: int | None = None) -> None:
        super().__init__()
        if aggregation not in AGGREGATIONS:
            raise ValueError(f"vectors are aggregated by one of {AGGREGATIONS}, not by {aggregation!r}")
        self.aggregation = aggregation
        self.raw_vectors = vectors.select(
            F.col("idx").cast("bigint").alias("idx"), F.col("term").cast("string").alias("term"),
            F.col("x").cast("double").alias("x"),
        )
        self.raw_support = support
        self.salt_threshold = salt_threshold
        self.vectors: DataFrame | None = None
        self.counts: DataFrame | None = None
        # what a merge left of the last similarity: pairs of unmoved nodes, its reach, the merged nodes
        self._carried: tuple[DataFrame, float, DataFrame] | None = None

    def seed(self, assign: DataFrame) -> None:
        super().seed(assign)
        self._carried = None

    def apply_moves(self, moves: DataFrame) -> None:
        """As for any analysis; pairs of nodes that neither moved nor took members in stay valid.

        Only a table that lists all its pairs can be carried on, not one with clique groups.
        """
        sim, reach, before = self._sim, self._sim_reach, self._carried
        complete = sim is not None and self._cliques is None and reach < 1.0
        super().apply_moves(moves)
        if not complete and (sim is not None or before is None):
            self._carried = None
            return
        kept, reach, merged = (sim, reach, None) if sim is not None else before
        new = moves.select(F.col("new").alias("node"))
        gone = moves.select("node")
        if merged is not None:
            new = new.unionByName(merged.join(gone, "node", "left_anti"))
        self._carried = (cut(touching(kept, gone.unionByName(new), inverse=True)), reach, cut(new.distinct()))

    def bind(self, atoms: DataFrame) -> None:
        sup = self.raw_support if self.raw_support is not None else _support_from(self.raw_vectors, ["idx"])
        sup = sup.select(F.col("idx").cast("bigint")).distinct()
        unknown = sup.join(atoms.select("idx"), "idx", "left_anti").limit(1).count()
        if unknown:
            raise ValueError("term analysis support holds atoms that are not in the universe")
        self._support = cut(sup)
        self._bound_vectors = self.raw_vectors.join(self._support, "idx", "left_semi")

    def _seed_state(self, assign: DataFrame) -> None:
        a = assign.join(self.support, "idx", "left_semi")
        self.vectors = cut(
            self._bound_vectors.join(a, "idx").groupBy(F.col("cid").alias("node"), "term").agg(F.sum("x").alias("x"))
        )
        self.counts = cut(a.groupBy(F.col("cid").alias("node")).agg(F.count(F.lit(1)).alias("n")))

    def _move_state(self, moves: DataFrame) -> None:
        v, c = contract_vectors_by_moves(self.vectors, self.counts, moves)
        self.vectors, self.counts = cut(v), cut(c)

    def aggregated(self) -> DataFrame:
        """Current cluster vectors, ``(node, term, x)`` by the configured aggregation."""
        if self.aggregation == "sum":
            return self.vectors
        return self.vectors.join(self.counts, "node").select("node", "term", (F.col("x") / F.col("n")).alias("x"))

    def _cosine(self, vectors: DataFrame, reach: float) -> DataFrame:
        if reach < 1.0:
            return cosine_at_least(vectors, 1.0 - reach, salt_threshold=self.salt_threshold)
        return cosine_similarity(vectors, salt_threshold=self.salt_threshold)

    def duplicate_groups(self) -> DataFrame | None:
        """``(node, g, m)`` of all nodes with a non-zero vector, or None if no
        two nodes share a unit vector (or collapsing is off)."""
        if not self.collapse_duplicates:
            return None
        groups = cut(duplicate_groups(self.vectors))
        if groups.where(F.col("m") >= 2).limit(1).count() == 0:
            return None
        return groups

    def _compute_similarity(self, reach: float) -> DataFrame:
        if self._carried is not None and self._carried[1] >= reach and self.collapse_duplicates:
            # after a merge: only the merged nodes are joined, against all
            kept, width, merged = self._carried
            self._carried = None
            fresh = cosine_at_least(self.vectors, 1.0 - width, salt_threshold=self.salt_threshold, changed=merged)
            return _within(kept.unionByName(fresh), reach)
        groups = self.duplicate_groups()
        if groups is None:
            return self._cosine(self.vectors, reach)
        # one representative per duplicate group; members of a group are a clique
        # (cosine 1) at every radius, and a pair of groups stands for all pairs of their members
        rep = self._cosine(representatives(self.vectors, groups), reach)
        rep = cut(rep.where(F.col("i") <= F.col("j")))  # two readers: the pairs are found once
        single = groups.where(F.col("m") == 1).select(F.col("node").alias("i"))
        self._cliques, self._clique_eps = groups, 0.0
        self._links = rep.where(F.col("i") < F.col("j"))
        return rep.where(F.col("i") == F.col("j")).join(single, "i", "left_semi")


class CombinedAnalysis(Analysis):
    """Weighted sum (or mean) of child analyses on the same support (M5, A4)."""

    name = "combined"

    def __init__(self, children: Sequence[Analysis], weights: Sequence[float] | None = None) -> None:
        super().__init__()
        if len(children) < 2:
            raise ValueError("a combined analysis needs at least two children")
        if weights is not None:
            if len(weights) != len(children):
                raise ValueError(f"{len(children)} children need as many weights, not {len(weights)}")
            if abs(sum(weights) - 1.0) > 1e-9:
                raise ValueError(f"weights must sum to 1, got {sum(weights)}")
        self.children = list(children)
        self.weights = list(weights) if weights is not None else None

    def bind(self, atoms: DataFrame) -> None:
        for c in self.children:
            c.bind(atoms)
        first = self.children[0].support
        for c in self.children[1:]:
            diff = first.join(c.support, "idx", "left_anti").limit(1).count() + c.support.join(
                first, "idx", "left_anti"
            ).limit(1).count()
            if diff:
                raise ValueError("children of a combined analysis must support the same atoms")
        self._support = first

    def seed(self, assign: DataFrame) -> None:
        for c in self.children:
            c.seed(assign)
        self._nodes = self.children[0].nodes()
        self._sim = None

    def apply_moves(self, moves: DataFrame) -> None:
        for c in self.children:
            c.apply_moves(moves)
        self._nodes = self.children[0].nodes()
        self._sim = None

    def _compute_similarity(self, reach: float) -> DataFrame:
        """Weighted combination of the pairs within ``reach``, pruned exactly.

        Edge children are computed in full (sparse by nature).  A pair outside
        every edge child's support can only reach the radius through the term
        children of positive weight (cosines of non-negative vectors do not fall below 0), so it
        needs ``cos >= (1 - reach) / W_P`` in one of them (``W_P`` = total of the positive
        term weights): those candidates come from the prefix
        filter.  Every candidate pair then gets the exact cosine of every term
        child, so the combination is exact for all pairs within the radius.
        Weights may have any sign as long as they sum to 1.
        """
        weights = self.weights or [1.0 / len(self.children)] * len(self.children)
        terms = [(c, w) for c, w in zip(self.children, weights) if isinstance(c, TermAnalysis)]
        raising = [(c, w) for c, w in terms if w > 0]
        w_t = sum(w for _, w in terms)
        signed = any(w < 0 and c.vectors.where(F.col("x") < 0).limit(1).count() for c, w in terms)
        if reach >= 1.0 or not terms or signed:
            sims = [c._cosine(c.vectors, 1.0) if isinstance(c, TermAnalysis) else c._compute_similarity(1.0)
                    for c in self.children]
            return _within(combine_similarities(sims, weights), reach)
        edge_sims = {id(c): cut(c._compute_similarity(1.0)) for c in self.children if not isinstance(c, TermAnalysis)}
        half = lambda df: df.where(F.col("i") <= F.col("j")).select("i", "j")
        cands = [half(s) for s in edge_sims.values()]
        # cosines are at most 1 but for rounding: a floor of 1 is still reached by equal directions
        tau_t = (1.0 - reach) / sum(w for _, w in raising) if raising else float("inf")
        reachable, tau_t = tau_t <= 1.0 + FLOOR_SLACK, min(tau_t, 1.0)
        # a negative edge weight may push pairs of a duplicate group out of a radius that others of it are
        # in: then the group is neither a clique nor without unlisted pairs, unless the radius is too small for either
        # (as may a user's similarity that falls below 0)
        lowering = any(
            w < 0 or not isinstance(c, CallAnalysis) and edge_sims[id(c)].where(F.col("sim") < 0).limit(1).count()
            for c, w in zip(self.children, weights) if not isinstance(c, TermAnalysis))
        collapse = self.collapse_duplicates and len(terms) == 1 and raising and not (
            lowering and round(reach, DISTANCE_DECIMALS) >= round(1.0 - w_t, DISTANCE_DECIMALS))
        groups = terms[0][0].duplicate_groups() if collapse else None
        if groups is None:
            if reachable:
                cands += [half(cosine_at_least(c.vectors, tau_t, salt_threshold=c.salt_threshold)) for c, _ in raising]
        else:
            # Inside a duplicate group every pair has combined similarity >= W_T, so
            # from radius 1 - W_T on the group is a clique and needs no pairs; below
            # that radius an intra-group pair qualifies only through an edge child,
            # whose support is listed anyway.  Outside the edge children's support every pair of
            # two groups has the same similarity, W_T times their cosine: one link each.
            t = terms[0][0]
            single = groups.where(F.col("m") == 1).select(F.col("node").alias("i"), F.col("node").alias("j"))
            cands.append(single)
            self._cliques, self._clique_eps = groups, float(round(1.0 - w_t, DISTANCE_DECIMALS))
            if reachable:
                rep = cosine_at_least(representatives(t.vectors, groups), tau_t, salt_threshold=t.salt_threshold)
                link = F.least(F.col("sim") * F.lit(float(w_t)), F.lit(1.0)).alias("sim")
                self._links = cut(_within(rep.where(F.col("i") < F.col("j")).select("i", "j", link), reach))
        if not cands:
            return combine_similarities([c._cosine(c.vectors, 1.0).limit(0) for c in self.children], weights)
        pairs = cands[0]
        for c in cands[1:]:
            pairs = pairs.unionByName(c)
        pairs = cut(pairs.distinct())
        sims = []
        for c in self.children:
            if isinstance(c, TermAnalysis):
                sims.append(_mirror(cosine_for_pairs(c.vectors, pairs)))
            else:
                sims.append(edge_sims[id(c)])
        return _within(combine_similarities(sims, weights), reach)
