"""Mixing sources to target weights by entropy balancing (operator 6).

Every document gets a rate r, the expected number of its copies in the mix.  Among all
rates that give each source its token target, the mix takes the one closest to "every
document once" in relative entropy, under a rate bound:

    minimise  sum r ln r - r + 1   subject to  sum_{i in s} r_i size_i = target_s,  0 <= r <= bound

whose solution tilts the rates exponentially, r_i = min(bound, exp(lambda_s size_i / scale_s)).
The convex dual in lambda is solved by Newton iterations.  A step is one distributed
aggregation over the table of distinct (source, size) pairs; the multipliers stay a
table keyed by source, and only the largest relative error reaches the driver.  Rates
are rounded to copies along the sizes of a source, so that rounding errors cancel, and the
last words are settled with a bounded set of documents per source.

Targets: sources sorted by code point (null last) weigh 3, 1, 2, repeating, and share
``share`` times all tokens; a target stops at ``bound`` times its source's size and the
excess is shared again by weight until none is above.

Edge cases: a null text or one without words has size 0, rate 1 and takes nothing (one copy);
a null source is a source of its own; a source without words has target 0; equal documents are
told apart by a hash of their key, repeated rows with one key by their position in the sort and
so may differ in copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import Flat, chunks, text_column
from strata.session import checkpoint_dir

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
BOUND = 2.0
MAX_STEPS = 60
TOLERANCE = 1e-9
#: Documents per source that may change by a copy to settle the last words, and size bands for rounding.
SETTLERS = 2048


def word_sizes(docs: DataFrame, text: str, size: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the number of words of the whole text (null: 0)."""
    (sent,) = own_name(docs, "whole_text")
    at = len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, batch.schema.names[at])
            n = np.zeros(len(texts), dtype=np.int64)
            for lo, hi in chunks(texts):
                n[lo:hi] = np.bincount(Flat(texts, lo, hi).words()[2], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(at)] + [pa.array(n)],
                                             names=keep + [size])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(size, "long")
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(sent))
    return slim.mapInArrow(count, schema)


def _kept(df: DataFrame) -> DataFrame:
    """A small or compact table, written once to the shared checkpoint folder."""
    if not checkpoint_dir(df.sparkSession):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return df.checkpoint(eager=True)


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's row (a null source equals a null source)."""
    other = per_source.withColumnRenamed("source", "source_")
    return rows.join(other, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def source_targets(
    counted: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, bound: float = BOUND
) -> DataFrame:
    """``(source, source_size, n_docs, target)`` of a table ``(source, size, n)`` of counted sizes.

    Water filling on one row per source (a window over sources, never over documents):
    in the order of room per weight the sources that stop at their bound are a prefix.
    """
    per = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"))
    by_code_point = Window.orderBy(F.col("source").isNull(), "source")  # UTF-8 byte order is code point order
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("at", (F.row_number().over(by_code_point) - 1) % len(weights))
    per = per.withColumn("weight", F.element_at(cycle, (F.col("at") + 1).cast("int")))
    per = per.withColumn("room", F.col("source_size") * F.lit(float(bound)))
    filling = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    done, every = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("room").over(done), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(done), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    per = per.withColumn("stops", F.col("level") * F.col("weight") >= F.col("room"))
    level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(every)
    target = F.when(F.col("stops"), F.col("room")).otherwise(level * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _rate(bound: float):
    """The tilted rate of a row with ``lam``, ``scale`` and ``size``; documents without words keep rate 1."""
    tilt = F.least(F.lit(float(bound)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
    return F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(bound))).otherwise(tilt)


def solve_dual(
    counted: DataFrame, targets: DataFrame, bound: float = BOUND, steps: int = MAX_STEPS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``targets`` with ``scale``, ``full`` and the multiplier ``lam`` of each source.

    Newton steps on the dual, one aggregation over the distinct sizes each; a step that
    leaves the bracket of the multiplier found so far is replaced by its middle.
    """
    state = targets.select(
        "source", "source_size", "n_docs", "target",
        F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)).alias("scale"),
        (F.col("target") >= F.col("source_size") * F.lit(float(bound))).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-1e3).alias("low"), F.lit(1e3).alias("high"))
    state = _kept(state)
    fields = state.columns
    for _ in range(steps):
        rows = _with_source(counted, state.select("source", "scale", "full", "lam"))
        got = F.col("n") * F.col("size") * F.col("r")
        sums = rows.withColumn("r", _rate(bound)).groupBy("source").agg(
            F.sum(got).alias("tokens"),
            F.sum(F.when(F.col("r") < bound, got * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        miss = F.col("target") - F.col("tokens")
        near = F.abs(miss) <= F.greatest(F.col("target"), F.lit(1.0)) * tolerance
        low = F.when(miss > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss < 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + miss / F.col("slope")
        # bracket ends that were never reached are far away: move towards them by doubling
        middle = F.when(F.col("high_") >= 1e3, F.greatest(F.col("lam") * 2, F.lit(1.0))).when(
            F.col("low_") <= -1e3, F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise(
            (F.col("low_") + F.col("high_")) / 2)
        inside = (F.col("slope") > 0) & (newton > F.col("low_")) & (newton < F.col("high_"))
        nxt = _with_source(state, sums)
        nxt = nxt.withColumn("done", near | F.col("full") | (F.col("source_size") == 0))
        nxt = nxt.withColumn("low_", low).withColumn("high_", high)
        nxt = nxt.withColumn("lam_", F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise(middle))
        state = _kept(nxt.select("source", "source_size", "n_docs", "target", "scale", "full",
                                 F.col("lam_").alias("lam"), F.col("low_").alias("low"), F.col("high_").alias("high"),
                                 "done"))
        if state.where(~F.col("done")).isEmpty():
            break
        state = state.select(fields)
    return state.select("source", "source_size", "n_docs", "target", "scale", "full", "lam")


def _settle(bound: float):
    """Change copies of one source's settlers until its tokens are near the target.

    First single copies, largest documents first, while they fit in the miss; then, while the miss
    shrinks, the single change or the exchange of two documents that leaves the least.
    """

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "mark", "key"], ascending=[False, True, True], kind="stable")
        miss = float(part["miss"].iloc[0])
        size, copies = part["size"].to_numpy(), part["copies"].to_numpy().copy()
        step = 1 if miss > 0 else -1
        for i in range(len(size)):
            if size[i] and size[i] <= abs(miss) and 0 <= copies[i] + step <= bound:
                copies[i] += step
                miss -= step * size[i]
        for _ in range(32):
            more = np.flatnonzero((size > 0) & (copies + 1 <= bound))
            less = np.flatnonzero((size > 0) & (copies >= 1))
            # an exchange adds one document and takes another; index -1 stands for none
            up, down = np.append(more, -1), np.append(less, -1)
            gain, loss = np.append(size[more], 0), np.append(size[less], 0)
            order = np.argsort(loss, kind="stable")
            at = np.searchsorted(loss[order], gain - miss)
            best = (abs(miss) - 0.5, -1, -1)
            for near in (np.clip(at - 1, 0, len(loss) - 1), np.clip(at, 0, len(loss) - 1)):
                left = np.abs(miss - gain + loss[order][near])
                left[up == down[order][near]] = np.inf
                i = int(np.argmin(left))
                if left[i] < best[0]:
                    best = (float(left[i]), int(up[i]), int(down[order][near][i]))
            if best[1] == best[2]:
                break
            for i, change in ((best[1], 1), (best[2], -1)):
                if i >= 0:
                    copies[i] += change
                    miss -= change * size[i]
        return part.assign(copies=copies)

    return settle


def mix_documents(
    sized: DataFrame,
    key: str,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    bound: float = BOUND,
    settlers: int = SETTLERS,
    shard_rows: int = 2_000,
) -> DataFrame:
    """``(key, source, size, source_size, target, rate, copies, taken)`` of a table ``(key, source, size)``.

    Rounding runs along the sizes of a shard: a shard holds about ``shard_rows``
    documents of one source, dealt by a hash of the key, so a source of any size is split.
    The same input gives the same copies in every run.
    """
    docs = _kept(sized.select(F.col(key).alias("key"), "source", "size", F.xxhash64(key).alias("mark")))
    counted = _kept(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    solved = solve_dual(counted, source_targets(counted, weights, share, bound), bound)
    rows = _with_source(docs, solved).withColumn("rate", _rate(bound))
    shards = F.ceil(F.col("n_docs") / F.lit(shard_rows))
    rows = rows.withColumn("shards", shards).withColumn("shard", F.pmod("mark", F.col("shards")))
    # rates are counted in 2**-40 so that sums are the same in any order
    rows = rows.withColumn("part", F.round(F.col("rate") * F.lit(float(1 << 40))).cast("long"))
    along = Window.partitionBy("source", "shard").orderBy("size", "mark", "key")
    total = F.sum("part").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = ((F.col("shard") * 2 + 1) * F.lit(float(1 << 40)) / (F.col("shards") * 2)).cast("long")
    upto, before = total + start, total + start - F.col("part")
    copies = F.shiftright(upto, 40) - F.shiftright(before, 40)
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("long"))
    out = ["key", "source", "size", "mark", "source_size", "n_docs", "target", "rate", "copies"]
    rows = _kept(rows.select(out))
    miss = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
    rows = _with_source(rows, miss)
    # about `settlers` documents of each source, by a second hash of the key
    lot = F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = lot * F.col("n_docs") < F.lit(float(settlers))
    moved = rows.where(chosen).select(*out, "miss").groupBy("source").applyInPandas(
        _settle(bound), rows.select(*out, "miss").schema)
    rows = rows.where(~chosen).select(out).unionByName(moved.select(out))
    return rows.select(
        F.col("key").alias(key), "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))
