"""The layer loop.

Every step is lazy DataFrame work; the driver only sees scalars (how many
clusters moved, how many core points).  Per step:

1. similarity of the stage's analysis at the current contraction -- reused from
   the cache while nothing merged since it was computed (rule 1);
2. the first radius at which this similarity merges anything (found once per table, by one aggregate): a step
   below it changes nothing and runs no job (rule 3), any other one runs DBSCAN at its radius;
3. ``moves(node, new)`` of the changed clusters, checkpointed;
4. if anything moved: the assignment of all atoms is one left join on the
   moves, and every analysis re-contracts its *already contracted* state by the
   same moves (rule 2), so tables shrink layer after layer.

Layers are kept as checkpointed ``(idx, cid)`` handles; a layer without change
reuses its predecessor's handle.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import DISTANCE_DECIMALS
from ..operators.dbscan import SELF_NEIGHBOR_MODES, dbscan, dbscan_labels
from ..operators.outliers import tag_outlier_intervals, tag_outliers
from ..operators.project import moves_from_labels, project
from ..session import cut
from . import schedule as sched
from .analyses import Analysis

# Class-level defaults of the low-level clustering call (K8).
DEFAULT_EPSILON = 0.5


@dataclass
class StepInfo:
    layer: int
    stage: int
    eps: float
    n_moved: int
    seconds: float


@dataclass
class Layers:
    """Result of a layer loop: handles per layer plus per-step statistics."""

    handles: list[DataFrame]
    steps: list[StepInfo] = field(default_factory=list)
    include_outliers: bool = False
    min_samples: int = 2
    deltas: list[DataFrame] = field(default_factory=list)

    def changes(self) -> DataFrame:
        """``(layer, idx, cid)`` only for atoms whose cluster changed at that layer.

        The compact form of :meth:`layers` (which holds every atom in every
        layer): layer 0 is the identity, and layer ``k`` equals layer ``k-1``
        overwritten by these rows.  Built from the moves, without another pass.
        """
        spark = self.handles[0].sparkSession
        out = spark.createDataFrame([], "layer int, idx bigint, cid bigint")
        for d in self.deltas:
            out = out.unionByName(d)
        return out  # clusters as merged; outlier tags are a view of :meth:`layers` and :meth:`final`

    def intervals(self) -> DataFrame:
        """``(idx, cid, first_layer, last_layer)``: an atom's clusters with the layers they hold in, both ends included.

        One row per atom and one per change, whatever the number of layers; :func:`layer_at` reads a layer back.
        """
        start = self.handles[0].select(F.lit(0).alias("layer"), "idx", "cid")
        turn = Window.partitionBy("idx").orderBy("layer")
        last = F.coalesce(F.lead("layer").over(turn) - 1, F.lit(self.n_layers - 1))
        out = start.unionByName(self.changes()).select(
            "idx", "cid", F.col("layer").alias("first_layer"), last.alias("last_layer"))
        return tag_outlier_intervals(out, self.min_samples) if self.include_outliers else out

    def layers(self) -> DataFrame:
        """``(layer INT, idx BIGINT, cid BIGINT)`` for every layer (layer 0 = singletons): the intervals spelt out."""
        return self.intervals().select(F.explode(F.sequence("first_layer", "last_layer")).alias("layer"), "idx", "cid")

    def final(self) -> DataFrame:
        """``(idx, cid)`` of the last layer (outliers tagged if requested)."""
        last = self.handles[-1].select("idx", "cid")
        if self.include_outliers:
            return tag_outliers(last.withColumn("layer", F.lit(0)), self.min_samples).select("idx", "cid")
        return last

    @property
    def n_layers(self) -> int:
        return len(self.handles)

    @property
    def merging_steps(self) -> int:
        return sum(1 for s in self.steps if s.n_moved > 0)


def layer_at(intervals: DataFrame, layer: int) -> DataFrame:
    """``(idx, cid)`` of one layer of the interval form: a range test per row."""
    return intervals.where((F.col("first_layer") <= int(layer)) & (F.col("last_layer") >= int(layer))).select("idx", "cid")


def cluster_step(
    analysis: Analysis,
    assign: DataFrame,
    eps: float,
    min_samples: int,
    self_neighbor: str = "distance",
    clusterer=None,
    reach: float | None = None,
) -> tuple[DataFrame, int]:
    """C4: one seeded step on an analysis whose state matches ``assign``.

    ``reach`` is the largest radius that later steps on this analysis use (default: this step's), so
    that one similarity table serves them all.  Returns ``(moves, n_moved)``; ``moves`` is checkpointed.
    """
    if clusterer is not None:
        # Any callable (sim, nodes, eps, min_samples) -> (node, label); label
        # -1 or null is noise, other labels name clusters (any values).  It gets every non-zero pair.
        lab = clusterer(analysis.full_similarity(), analysis.nodes(), eps, min_samples)
        lab = lab.where(F.col("label").isNotNull() & (F.col("label") != -1)).select("node", "label")
        moves = cut(moves_from_labels(lab))
        return moves, moves.count()
    reach = max(eps, eps if reach is None else reach)
    sim = analysis.similarity(reach)
    if eps < 1.0 and analysis.next_merge(reach, min_samples, self_neighbor) > round(eps, DISTANCE_DECIMALS):
        return assign.sparkSession.createDataFrame([], "node bigint, new bigint"), 0
    links = analysis.links_at(eps)
    res = dbscan(sim, analysis.nodes(), eps, min_samples, self_neighbor, analysis.cliques_at(eps),
                 merges=links is None, links=links)
    moves = cut(moves_from_labels(res.labels.select("node", "label")))
    return moves, moves.count()


def cluster_from_scratch(
    analysis: Analysis, atoms: DataFrame, eps: float, min_samples: int, self_neighbor: str = "distance"
) -> DataFrame:
    """One unseeded step; ``(idx, cid)`` with -1 for noise and unsupported atoms."""
    analysis.bind(atoms)
    identity = atoms.select("idx", F.col("idx").alias("cid"))
    analysis.seed(identity)
    sim = analysis.similarity(eps)
    lab = dbscan_labels(sim, analysis.nodes(), eps, min_samples, self_neighbor, noise=-1,
                        cliques=analysis.cliques_at(eps), links=analysis.links_at(eps))
    return atoms.select("idx").join(lab.withColumnRenamed("node", "idx"), "idx", "left").select(
        "idx", F.coalesce(F.col("label"), F.lit(-1).cast("bigint")).alias("cid")
    )


def _reaches(pipeline: Sequence[Analysis], radii: Sequence[Sequence[float]]) -> list[float]:
    """Per stage the largest radius that any stage with the same analysis uses."""
    return [max(e for other, own in zip(pipeline, radii) if other is a for e in own or [0.0]) for a in pipeline]


def cluster(
    atoms: DataFrame,
    pipeline: Sequence[Analysis],
    epsilons: Sequence[float] | None = None,
    max_iterations: int = 50,
    min_samples: int = 2,
    epsilon_step: float = 0.05,
    strategy: str = "alternating",
    include_outliers: bool = False,
    self_neighbor: str = "distance",
    log=None,
    clusterer=None,
) -> Layers:
    """Run a strategy over ``pipeline`` and return every layer.

    ``atoms(idx, ...)`` is the universe; layer 0 puts every atom in its own
    cluster.  Defaults are those of the low-level call (K8).  ``clusterer``
    replaces DBSCAN by a user callable (O12).
    """
    sched.validate(strategy, len(pipeline), epsilons)
    if self_neighbor not in SELF_NEIGHBOR_MODES:
        raise ValueError(f"self_neighbor must be one of {SELF_NEIGHBOR_MODES}")
    if not isinstance(min_samples, int):
        warnings.warn(f"min_samples {min_samples!r} is taken as {int(min_samples)}", stacklevel=2)
        min_samples = int(min_samples)
    if epsilons is None:
        epsilons = [DEFAULT_EPSILON] * len(pipeline)

    assign = cut(atoms.select("idx", F.col("idx").alias("cid")))
    distinct = list({id(a): a for a in pipeline}.values())  # an analysis may serve several stages
    for a in distinct:
        a.bind_once(atoms)
        a.seed(assign)

    result = Layers([assign], include_outliers=include_outliers, min_samples=min_samples)

    def run(stage: int, eps: float) -> int:
        nonlocal assign
        t0 = time.time()
        a = pipeline[stage]
        moves, n_moved = cluster_step(a, assign, eps, min_samples, self_neighbor, clusterer, reach[stage])
        if n_moved:
            layer_no = len(result.handles)
            result.deltas.append(
                assign.join(moves.select(F.col("node").alias("cid"), "new"), "cid").select(
                    F.lit(layer_no).alias("layer"), "idx", F.col("new").alias("cid")
                )
            )
            assign = cut(project(assign, moves))
            for b in distinct:
                b.apply_moves(moves)
        result.handles.append(assign)
        info = StepInfo(len(result.handles) - 1, stage, eps, n_moved, time.time() - t0)
        result.steps.append(info)
        if log:
            log(info)
        return n_moved

    if strategy == "alternating":
        reach = _reaches(pipeline, [[e] for e in epsilons])
        for turn in range(max_iterations):
            merged = sum(run(stage, eps) for stage, eps in enumerate(epsilons))
            if turn and not merged:
                break
        return result

    ladders = [sched.radii(top, epsilon_step, whole=strategy == "alternating_epsilon") for top in epsilons]
    reach = _reaches(pipeline, ladders)
    for stage, eps in sched.plan(strategy, epsilons, epsilon_step):
        run(stage, eps)
    return result
