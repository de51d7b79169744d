"""Incremental trace edges with Structured Streaming.

Rows of ordered traces arrive in micro-batches.  Each batch is processed with
``foreachBatch``:

1. rows that are not after the last row seen of their trace are *late*: what follows what
   has been counted already, so they are set aside (``late``, one folder per batch) and not linked;
2. the other rows are unioned with the last row seen of their traces, and transitions are counted as
   in R1 (a huge trace is split the same way);
3. the batch's counts are written as the partition of its epoch; they add up on read;
4. the last row of every trace is written as the state after this epoch.

Within a batch rows may come in any order; batches must bring a trace's rows in order to
have them all linked.  Where they do not, give a ``lateness``: then the rows of a trace are keyed state, and
late ones are linked again (:mod:`strata.streaming.relink`).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from ..sources.derive import trace_edges
from .relink import run_relinked


def _state_of(spark: SparkSession, path: str, epoch: int, schema) -> DataFrame:
    """The last rows after ``epoch``; an error where that state is not there.

    A state holds one row without a trace that names its epoch, so an empty state is told from a lost one.
    """
    state = spark.read.schema(schema).parquet(path)
    if state.where((F.col("_epoch") == epoch) & F.col("_mark")).limit(1).count() == 0:
        raise RuntimeError(f"the stream's state after epoch {epoch} is missing under {path}; restart with a new folder")
    return state.where(~F.col("_mark")).drop("_epoch", "_mark")


def make_batch_handler(spark: SparkSession, trace: str, order: Sequence[str], atom: str, base: str):
    """``foreachBatch`` function; state, counts and late rows live under ``base``.

    Counts and late rows are keyed by the epoch id and the state has two slots, of even and odd epochs,
    so a batch that runs again after a restart reads the same previous state and overwrites its own
    outputs: the running totals never double count, and the state never grows with the number of batches.
    """
    edges_dir = f"{base}/edges"
    key = F.struct(*[F.col(c) for c in order])

    def handle(batch: DataFrame, epoch_id: int) -> None:
        rows = batch.select(trace, *order, atom).where(F.col(atom).isNotNull())
        schema = T.StructType([*rows.schema, T.StructField("_epoch", T.LongType()), T.StructField("_mark", T.BooleanType())])
        known = rows.limit(0)
        if epoch_id > 0:
            known = _state_of(spark, f"{base}/last/slot={(epoch_id - 1) % 2}", epoch_id - 1, schema)
        last = known.select(F.col(trace).alias("_trace"), key.alias("_last"))
        placed = rows.join(last, F.col(trace).eqNullSafe(F.col("_trace")), "left").withColumn("_key", key)
        is_late = F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False))
        placed.where(is_late).select(trace, *order, atom).write.mode("overwrite").parquet(f"{base}/late/epoch={epoch_id}")
        fresh = placed.where(~is_late).select(trace, *order, atom)
        touched = fresh.select(F.col(trace).alias("_trace")).distinct()
        joined = fresh.unionByName(known.join(touched, F.col(trace).eqNullSafe(F.col("_trace")), "left_semi"))
        trace_edges(joined, trace, order, atom).write.mode("overwrite").parquet(f"{edges_dir}/epoch={epoch_id}")
        newest = known.unionByName(fresh).groupBy(trace).agg(F.max_by(F.struct(*order, atom), key).alias("r")).select(
            trace, *[F.col(f"r.{c}").alias(c) for c in [*order, atom]])
        mark = spark.createDataFrame([(None,) * len(rows.columns) + (epoch_id, True)], schema)
        state = newest.select(*rows.columns, F.lit(epoch_id).cast("long").alias("_epoch"), F.lit(False).alias("_mark"))
        state.unionByName(mark).write.mode("overwrite").parquet(f"{base}/last/slot={epoch_id % 2}")

    return handle, edges_dir


def stream_trace_edges(
    spark: SparkSession,
    path: str,
    trace: str,
    order: Sequence[str],
    atom: str,
    max_files_per_trigger: int | None = None,
    glob: str | None = None,
    folder: str | None = None,
    lateness: str | None = None,
) -> DataFrame:
    """Run a stream over the parquet files of folder ``path`` (optionally only those
    matching ``glob``) to completion and return the accumulated ``(src, dst, w)`` edges.

    ``folder`` (shared storage) keeps the stream's progress, state and counts: a later call with
    the same folder goes on with the files that are new.  Without it the run starts afresh in a new
    folder of ``spark.checkpoint.dir``.

    ``lateness`` (an interval) says how much older than the newest row seen a row may be: rows within it are
    linked as if they had come in order.  Without it rows behind their trace's last one are set aside.
    """
    if folder is None:
        shared = checkpoint_dir(spark)
        if not shared:
            raise RuntimeError("give a folder, or set spark.checkpoint.dir to a shared one")
        folder = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    base = folder.rstrip("/")
    batch_reader = spark.read
    reader = spark.readStream.format("parquet")
    if glob:
        batch_reader = batch_reader.option("pathGlobFilter", glob)
        reader = reader.option("pathGlobFilter", glob)
    reader = reader.schema(batch_reader.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if lateness is not None:
        return accumulated_edges(spark, run_relinked(spark, reader.load(path), trace, order, atom, lateness, base))
    handle, edges_dir = make_batch_handler(spark, trace, order, atom, base)
    q = (
        reader.load(path)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{base}/query")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return accumulated_edges(spark, edges_dir)


def accumulated_edges(spark: SparkSession, edges_dir: str) -> DataFrame:
    """Running total of the per-batch counts (one partition per epoch); edges taken back are gone."""
    return spark.read.parquet(edges_dir).groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w != 0")
