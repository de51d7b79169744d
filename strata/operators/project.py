"""Turn cluster labels of nodes into an assignment of atoms.

Nodes of a step are the seed clusters holding at least one supported atom, and a
node id is the smallest atom index in it.  After DBSCAN the new id of a cluster
is the smallest node id in it (so again the smallest atom index), noise keeps
its own id (C3), and only changed clusters are listed as ``moves(node, new)``.

Projection is then one left join of the full assignment on its cluster id:
supported atoms, unsupported atoms riding along in a supported seed cluster
(J6) and seed clusters without any supported atom (J7, unchanged) are all
handled by ``coalesce(new, cid)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moves_from_labels(labels: DataFrame) -> DataFrame:
    """``labels(node, label)`` of clustered nodes -> ``moves(node, new)``, changed only."""
    canon = labels.groupBy("label").agg(F.min("node").alias("new"))
    return (
        labels.join(canon, "label")
        .where(F.col("new") != F.col("node"))
        .select("node", "new")
    )


def project(assign: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply ``moves`` to an assignment ``(idx, cid)``."""
    m = moves.select(F.col("node").alias("cid"), "new")
    return assign.join(m, "cid", "left").select("idx", F.coalesce(F.col("new"), F.col("cid")).alias("cid"))
