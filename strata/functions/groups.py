"""Duplicate groups: nodes whose unit term vectors are identical.

Every pair inside such a group has cosine exactly 1, so the group is a clique of
neighbours for DBSCAN (in a term analysis at every radius; in a combined
analysis once the radius covers ``1 - W_terms``).  Emitting those pairs would
be quadratic in the group size -- one name shared by a third of all parts would
make the neighbour table as large as the square of a third of the input.
Instead the group is carried as ``(node, g, m)`` (``g`` = smallest member,
``m`` = size) and only one representative per group enters pair generation; a pair
of representatives stands for all pairs of their members.

Identity is decided by an order-independent fingerprint of the unit vector: the
number of terms and two sums of independent 61-bit hashes of ``(term, u)`` in
exact decimal arithmetic.  Vectors that are equal up to scale by a power of two
share unit vectors bit for bit; other near-equal vectors simply stay apart and
are handled as ordinary pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import normalise

# Modulus of the hash fingerprints (a Mersenne prime); fixed value.
_P = (1 << 61) - 1


def duplicate_groups(vectors: DataFrame) -> DataFrame:
    """``(node, g, m)`` for every node with a non-zero vector."""
    u = normalise(vectors)
    h = lambda seed: F.sum(
        F.pmod(F.xxhash64(F.lit(seed), "term", "u"), F.lit(_P)).cast("decimal(38,0)")
    )
    key = u.groupBy("node").agg(F.count(F.lit(1)).alias("nt"), h(17).alias("h1"), h(29).alias("h2"))
    grp = key.groupBy("nt", "h1", "h2").agg(F.min("node").alias("g"), F.count(F.lit(1)).alias("m"))
    return key.join(grp, ["nt", "h1", "h2"]).select("node", "g", "m")


def representatives(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Vectors of one node per group (the smallest), keyed by that node."""
    reps = groups.where(F.col("node") == F.col("g")).select("node")
    return vectors.join(reps, "node", "left_semi")
