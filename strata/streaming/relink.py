"""R6 with rows out of order: trace edges kept right by keyed state, re-linking what comes late.

Every trace is a key of a stateful operator (``transformWithState``).  Its state, in the engine's
state store, is the ordered list of the trace's recent rows.  A micro-batch merges its rows into the
lists of the traces it touches and emits *signed* counts: a row that falls between two linked rows
takes their edge back (-1) and adds the two edges through itself (+1 each).  Summed over all
batches the counts equal R1 over the whole input, whatever the order of arrival.

Lateness is bounded by the caller and enforced by an event-time watermark, the largest time seen minus the bound:

* a row at or before the watermark is dropped by the engine; the number of such rows is reported
  as a warning, never silently;
* rows that the watermark has passed cannot get a new neighbour except behind the newest of
  them, so a list keeps that one and the rows after the watermark.  Lists are trimmed when their trace is
  touched, and by an event-time timer when it is not: an idle trace holds one row.

State is thus the rows of one lateness bound plus a row per trace.  Only the traces of a batch are read and
written, the store keeps the rest; a batch that runs again after a failure starts from the state
before it and overwrites its own counts.  The rows of one trace in one batch are ordered by one task, so the
size of a batch bounds that task.

Times: a timestamp or date, or a number taken as seconds since 1970, from 1922 to 2214 (a watermark starts
at 1970 and pandas times end in 2262, so event times are shifted by :data:`SHIFT`).  A row whose time is
null has no place under a watermark and is left out, as are rows of a null atom.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds added to event times: a stream's first watermark is 1970, and rows at or before it are dropped.
SHIFT = 1_500_000_000 * 1_000_000


def event_micros(column: str, kind: T.DataType) -> Column:
    """The event time of a row in shifted microseconds: a timestamp, a date at midnight, or a number as seconds."""
    if isinstance(kind, T.NumericType):
        return (F.col(column) * 1_000_000).cast("long") + SHIFT
    return F.unix_micros(F.col(column).cast("timestamp")) + SHIFT


def _before(row: tuple) -> tuple:
    """Sort key of a row ``(time, *order, atom)``: the order columns, nulls first."""
    return tuple((v is not None, v) for v in row[1:-1])


def merged(held: list[tuple], new: list[tuple], watermark: int) -> tuple[list[tuple], Counter]:
    """The list after the new rows, trimmed to the watermark, and the change of the edge counts."""
    rows = sorted(held + new, key=_before)
    change = Counter(zip((r[-1] for r in rows), (r[-1] for r in rows[1:])))
    change.subtract(Counter(zip((r[-1] for r in held), (r[-1] for r in held[1:]))))
    return trimmed(rows, watermark), change


def trimmed(rows: list[tuple], watermark: int) -> list[tuple]:
    """The rows after the watermark (microseconds) and the one before them."""
    passed = next((i for i, r in enumerate(rows) if r[0] > watermark), len(rows))
    return rows[max(passed - 1, 0) :]


class Relink(StatefulProcessor):
    """Keeps the recent rows of every trace and emits signed edge counts."""

    def __init__(self, state: T.StructType):
        self.schema = state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", self.schema)

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.recent.get()] if self.recent.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in self.schema.names]
            new += list(zip(*columns))
        kept, change = merged(self._held(), new, timerValues.getCurrentWatermarkInMs() * 1000)
        self.recent.put(kept)
        self.handle.registerTimer(max(r[0] for r in kept) // 1000 + 1)
        found = [(a, b, n) for (a, b), n in change.items() if n]
        if found:
            yield pd.DataFrame(found, columns=["src", "dst", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held:
            self.recent.put(trimmed(held, timerValues.getCurrentWatermarkInMs() * 1000))
        return iter(())

    def close(self) -> None:
        pass


def relinked_edges(stream: DataFrame, trace: str, order: Sequence[str], atom: str, lateness: str) -> DataFrame:
    """Signed counts ``(src, dst, n)`` of a streaming frame; their sum is R1's ``w``.

    ``order`` must break every tie inside a trace; its first column is the event time.  ``lateness`` is an
    interval such as ``"2 hours"``.
    """
    order = list(order)
    kinds = dict(zip(stream.columns, (f.dataType for f in stream.schema)))
    at = event_micros(order[0], kinds[order[0]])
    # timestamps and dates travel as integers: same order, and no conversion in the state
    plain = [F.unix_micros(F.col(c).cast("timestamp")) if isinstance(kinds[c], (T.TimestampType, T.DateType, T.TimestampNTZType))
             else F.col(c) for c in order]
    slim = stream.where(F.col(atom).isNotNull() & at.isNotNull()).select(
        F.col(trace).alias("trace"), F.timestamp_micros(at).alias("event_time"), at.alias("at"),
        *[c.alias(f"o{i}") for i, c in enumerate(plain)], F.col(atom).alias("atom"))
    state = T.StructType([slim.schema[c] for c in ("at", *[f"o{i}" for i in range(len(order))], "atom")])
    out = T.StructType([T.StructField("src", kinds[atom]), T.StructField("dst", kinds[atom]), T.StructField("n", T.LongType())])
    return slim.withWatermark("event_time", lateness).groupBy("trace").transformWithStateInPandas(
        Relink(state), out, outputMode="Update", timeMode="EventTime")


def run_relinked(spark: SparkSession, stream: DataFrame, trace: str, order: Sequence[str], atom: str, lateness: str,
                 folder: str) -> str:
    """Run the stream to its end; progress, state and counts live under ``folder`` (shared storage).

    Returns the folder of the counts, one partition per epoch.
    """
    edges_dir = f"{folder}/edges"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("w")).write.mode("overwrite").parquet(
            f"{edges_dir}/epoch={epoch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            relinked_edges(stream, trace, order, atom, lateness).writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{folder}/query").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    if dropped:
        warnings.warn(f"{dropped} rows came later than {lateness} and are not linked", stacklevel=3)
    return edges_dir
