"""Connected components by alternating large-star / small-star rounds.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: "Connected components in
MapReduce and beyond" (SoCC 2014).  Edges are kept as ``(hi, lo)`` with
``lo < hi``; every operation is a group-by on a node plus a join, so a hub node
is a partial aggregate, never a collected list.

* large-star: each node ``u`` links every *larger* neighbour to ``m(u)``, the
  minimum of ``u`` and its neighbours;
* small-star: each node links itself and its *smaller* neighbours to the
  minimum of them.

Both steps leave a set of stars centred on component minima unchanged; a round
in which neither step changes anything ends the loop.  Each step's output is
checkpointed, so the plan does not grow with the number of rounds and a lost
executor only costs the current step; a small edge list is read in few partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, gathered


def _orient(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col("hi") != F.col("lo"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(
        e.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
    )
    m = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    # only x's larger neighbours y are relinked, to m(x)
    return (
        e.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
        .join(m, "x")
        .select(
            F.col("y").alias("hi"),
            F.col("m").alias("lo"),
            (F.col("m") < F.col("x")).alias("changed"),
        )
    )


def _small_star(e: DataFrame) -> DataFrame:
    m = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("deg"))
    j = e.join(m, "hi")
    # every smaller neighbour of hi, and hi itself, links to m
    out = j.select(
        F.explode(F.array(F.col("lo"), F.col("hi"))).alias("v"),
        F.col("m"),
        (F.col("deg") > 1).alias("changed"),
    ).where(F.col("v") != F.col("m"))
    return out.select(F.col("v").alias("hi"), F.col("m").alias("lo"), "changed")


def _step(e: DataFrame, op) -> tuple[DataFrame, bool]:
    out = op(e).groupBy("hi", "lo").agg(F.max("changed").alias("changed"))
    out = gathered(cut(out))
    changed = out.where(F.col("changed")).limit(1).count() > 0
    return out.select("hi", "lo"), changed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``(node, label)`` for every node touched by ``edges``; label = component minimum.

    Nodes without edges are not in the output: callers keep their own id
    (``coalesce(label, node)``).
    """
    e = gathered(cut(_orient(edges, src, dst).distinct()))
    for _ in range(max_rounds):
        e, c1 = _step(e, _large_star)
        e, c2 = _step(e, _small_star)
        if not c1 and not c2:
            break
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("label"))
    ).distinct()
