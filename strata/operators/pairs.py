"""Self-join on a shared key with hot-key salting.

``rows(k, node, v)``: for every pair of nodes ``i <= j`` that share a key ``k``,
``s = sum_k combine(v_i, v_j)``.  A key held by very many rows (a hub caller, a
frequent term) would put its whole pair list into one task; such keys are split
into ``ceil(deg / threshold)`` salt buckets on one side, and the other side is
replicated once per bucket, so every pair is still produced exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows per key above which a key is salted; fixed default, overridable per call.
DEFAULT_SALT_THRESHOLD = 50_000
# Hot-key tables larger than this are joined by shuffle instead of broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def hot_keys(rows: DataFrame, key: str, threshold: int) -> DataFrame:
    """Keys with more than ``threshold`` rows and their salt count, cached."""
    hot = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("deg"))
        .where(F.col("deg") > threshold)
        .select(key, F.ceil(F.col("deg") / F.lit(threshold)).cast("int").alias("nsalt"))
        .cache()
    )
    return hot


def join_bounded(big: DataFrame, small: DataFrame, on, how: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join with ``small`` broadcast only when its row count is proven small."""
    n = small.count()
    side = F.broadcast(small) if n <= max_rows else small
    return big.join(side, on, how)


def pairs_sharing_key(
    rows: DataFrame,
    combine: Callable[[Column, Column], Column],
    salt_threshold: int | None = None,
) -> DataFrame:
    """Half matrix ``(i, j, s)`` with ``i <= j`` over rows ``(k, node, v[, r][, c])``.

    With an ``r`` column the result also carries ``ub = max(r_i * r_j)`` over the
    shared keys (used as an upper bound by the prefix-filtered cosine join).  With a boolean ``c``
    column only pairs with a node of ``c`` are made: one side of the join holds those rows alone.
    """
    threshold = DEFAULT_SALT_THRESHOLD if salt_threshold is None else salt_threshold
    has_r, has_c = "r" in rows.columns, "c" in rows.columns
    ra = [F.col("r").alias("ra")] if has_r else []
    rb = [F.col("r").alias("rb")] if has_r else []
    cb = [F.col("c").alias("cb")] if has_c else []
    chosen = (lambda df: df.where("c")) if has_c else (lambda df: df)
    hot = hot_keys(rows, "k", threshold)
    if hot.limit(1).count() == 0:
        hot.unpersist()
        a = chosen(rows).select("k", F.col("node").alias("i"), F.col("v").alias("va"), *ra)
        b = rows.select("k", F.col("node").alias("j"), F.col("v").alias("vb"), *rb, *cb)
        joined = a.join(b, "k")
    else:
        tagged = join_bounded(rows, hot, "k", "left").withColumn(
            "nsalt", F.coalesce(F.col("nsalt"), F.lit(1))
        )
        a = chosen(tagged).select(
            "k",
            F.pmod(F.xxhash64("node"), F.col("nsalt")).cast("int").alias("salt"),
            F.col("node").alias("i"),
            F.col("v").alias("va"),
            *ra,
        )
        b = tagged.select(
            "k",
            F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt"),
            F.col("node").alias("j"),
            F.col("v").alias("vb"),
            *rb,
            *cb,
        )
        joined = a.join(b, ["k", "salt"])
    aggs = [F.sum(combine(F.col("va"), F.col("vb"))).alias("s")]
    if has_r:
        aggs.append(F.max(F.col("ra") * F.col("rb")).alias("ub"))
    if has_c:  # a pair of two chosen nodes comes in both orientations, any other in one
        half = joined.where(~F.col("cb") | (F.col("i") <= F.col("j")))
        return half.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(*aggs)
    return joined.where(F.col("i") <= F.col("j")).groupBy("i", "j").agg(*aggs)
