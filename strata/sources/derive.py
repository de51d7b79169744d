"""Derive analysis inputs from ordinary tables.

* R1 ``trace_edges``    -- transitions atom -> next atom inside ordered traces;
* R2 ``relation_edges`` -- interaction counts from joined relations;
* R3 ``word_counts``    -- term counts per entity from text;
* R4 ``tfidf``          -- smoothed TF-IDF weights;
* R5 ``index_atoms``    -- a dense, ordered index of entity keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

# Tokens: runs of ASCII letters in lower-cased text.  Fixed value; the SQL
# oracle uses the same pattern.
WORD_PATTERN = "([a-z]+)"
# Bytes of text that a task counts at once (a longer text is counted alone).  Fixed value.
COUNT_BYTES = 1 << 20
# Terms of several entities whose hashes and frequencies are sent to the tasks at most.  Fixed value.
VOCABULARY_ROWS = 1_500_000
# Traces longer than this are cut into contiguous pieces so no single task sorts a
# huge trace, at every so-many-th of the sampled order keys.  Fixed defaults.
HOT_TRACE_ROWS = 2_000_000
CUT_SAMPLE = 32


def _cuts(base: DataFrame, trace: str, order: list[str], threshold: int) -> DataFrame:
    """``(trace, cuts, strides)`` of every trace longer than ``threshold``: ascending order keys that cut it into pieces.

    The keys are real rows' keys, the whole order as a struct, so any orderable types will do and rows
    that tie in the first columns are still split.  They come from rows chosen by a hash, about
    ``CUT_SAMPLE`` per piece; an uneven choice makes uneven pieces, never another result.
    """
    key = F.struct(*[F.col(c) for c in order])
    long = base.groupBy(F.col(trace).alias("_trace")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > threshold)
    rows = base.join(long, F.col(trace).eqNullSafe(F.col("_trace")))
    lot = F.pmod(F.xxhash64(*order), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.where(lot * threshold < CUT_SAMPLE).select("_trace", key.alias("_key"))
    keys = some.groupBy("_trace").agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    cuts = keys.select("_trace", F.filter("_keys", lambda k, i: i % CUT_SAMPLE == CUT_SAMPLE - 1).alias("_cuts"))
    # the strides of a search over the cuts: falling powers of two, the first one at most their number
    strides = F.transform(F.sequence(F.floor(F.log2(F.size("_cuts"))).cast("int"), F.lit(0), F.lit(-1)),
                          lambda e: F.call_function("shiftleft", F.lit(1), e))
    return cuts.where(F.size("_cuts") > 0).select("_trace", "_cuts", strides.alias("_strides"))


def trace_edges(
    df: DataFrame,
    trace: str,
    order: Sequence[str],
    atom: str,
    hot_threshold: int = HOT_TRACE_ROWS,
) -> DataFrame:
    """``(src, dst, w)`` = number of times ``dst`` directly follows ``src``.

    ``order`` must break every tie inside a trace.  A trace with more than ``hot_threshold`` rows is
    cut into pieces along its whole order; each piece is ordered on its own, and the last row of a
    piece is linked to the first row of the next one that has rows.  So the result is exact and
    the same for every threshold.  A null trace is a trace like any other; rows of a null atom
    are left out.
    """
    order = list(order)
    base = df.select(trace, *order, atom).where(F.col(atom).isNotNull())
    key = F.struct(*[F.col(c) for c in order])
    # how many cuts are at most the row's key, by halving strides: log2 of the pieces per row
    piece = F.aggregate(
        "_strides", F.lit(0),
        lambda at, by: F.when(F.get("_cuts", at + by - 1) <= key, at + by).otherwise(at))
    tagged = base.join(_cuts(base, trace, order, hot_threshold), F.col(trace).eqNullSafe(F.col("_trace")), "left")
    # dealt by trace and piece: the pieces of one trace may go to different tasks
    tagged = tagged.select(trace, *order, atom, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(piece).alias("_piece"))
    w = Window.partitionBy(trace, "_piece").orderBy(*order)
    within = tagged.select(F.col(trace).alias("_t"), "_piece", F.col(atom).alias("src"), F.lead(atom).over(w).alias("dst"))
    ends = tagged.groupBy(trace, "_piece").agg(F.min_by(atom, key).alias("first"), F.max_by(atom, key).alias("last"))
    wp = Window.partitionBy(trace).orderBy("_piece")
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(wp).alias("dst"))
    pairs = within.select("src", "dst").unionByName(across).where(F.col("dst").isNotNull())
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def relation_edges(df: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """R2: ``(src, dst, w)`` summed over joined relation rows (count when no weight)."""
    w = F.sum(F.col(weight)).cast("double") if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(w.alias("w"))


def tokens(text) -> object:
    """Array of lower-case ASCII-letter runs of a text column (whole text)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 1)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, lower-cased text)`` to ``(idx, term, n)``: the letter runs of each text, each term once a row."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + COUNT_BYTES, side="right")) - 1)
            hi = min(hi, len(texts))
            buf, starts = whole[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            letter = (buf - np.uint8(ord("a"))) < 26
            first = letter.copy()
            first[1:] &= ~letter[:-1]
            begins = starts[:-1][starts[:-1] < len(buf)]
            first[begins] = letter[begins]  # a run ends with its text
            at = np.flatnonzero(first)
            runs = np.append(np.cumsum(letter)[at] - 1, np.count_nonzero(letter)).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(runs), pa.py_buffer(buf[letter]))
            coded = words.cast(pa.string()).dictionary_encode()
            wide = max(1, len(coded.dictionary))
            owner = np.searchsorted(starts, at, side="right") - 1
            cells, n = np.unique(owner * wide + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(lo + cells // wide)), coded.dictionary.take(pa.array(cells % wide)),
                 pa.array(n.astype(np.int64))], names=["idx", "term", "n"])
            lo = hi


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(idx, term, n)`` occurrences of each term in each entity's text.

    A task counts the words of every row by itself.  Only where rows share a key are the rows' counts added up
    by a shuffle; where no two do, they are the result as they are.
    """
    rows = df.select(F.col(key).alias("idx"), F.lower(F.col(text)).alias("text"))
    schema = rows.select("idx").schema.add("term", "string").add("n", "long")
    counted = spread(rows).mapInArrow(_counted_words, schema)
    shared = rows.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if shared.limit(1).count() == 0:
        return counted
    return counted.groupBy("idx", "term").agg(F.sum("n").alias("n"))


def tfidf(counts: DataFrame, n_docs: int | None = None, max_broadcast_rows: int = VOCABULARY_ROWS,
          kept: bool = False) -> DataFrame:
    """``(idx, term, x)`` with ``x = n * (ln((1 + N) / (1 + df)) + 1)``.

    ``N`` = number of entities with at least one term (or ``n_docs``), ``df`` =
    entities containing the term.  Smoothed IDF, no row normalisation (cosine
    does not need it).  The vocabulary is counted once; up to ``max_broadcast_rows`` terms of several entities are sent to the
    tasks by their hashes, if these all differ, and any other term has one entity: the counts stay where they are.

    ``kept``: the result has several readers, so it is materialised where the counts had to be shuffled.
    """
    if n_docs is None:
        n_docs = counts.select("idx").distinct().count()
    dfreq = cut(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    code = F.xxhash64("term")
    several = dfreq.where(F.col("df") > 1).select(code.alias("_code"), "df")
    sent = several.count() <= max_broadcast_rows and dfreq.groupBy(code).count().where("count > 1").limit(1).count() == 0
    if sent:
        weighed = counts.where(F.col("term").isNotNull()).withColumn("_code", code).join(F.broadcast(several), "_code", "left")
        weighed = weighed.withColumn("df", F.coalesce("df", F.lit(1)))
    else:
        weighed = counts.join(dfreq, "term")
    out = weighed.select("idx", "term", (F.col("n") * idf).alias("x"))
    return cut(out) if kept and not sent else out


def index_atoms(df: DataFrame, col: str) -> DataFrame:
    """``(atom, idx)`` -- distinct keys numbered 0.. in sorted order.

    JVM-only and distributed: keys are range-partitioned and sorted, each row
    gets its position inside its partition from ``monotonically_increasing_id``
    (partition id in the upper bits), and a per-partition offset -- a table with
    one row per partition, so its broadcast is bounded -- makes the numbers dense.
    """
    spark = df.sparkSession
    n_parts = max(1, spark.sparkContext.defaultParallelism)
    keys = (
        df.select(F.col(col).alias("atom")).where(F.col("atom").isNotNull()).distinct()
        .repartitionByRange(n_parts, "atom").sortWithinPartitions("atom")
        .select("atom", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    )
    keys = cut(keys)
    counts = keys.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return keys.join(F.broadcast(offsets), "_p").select(
        "atom", (F.col("_off") + F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)).alias("idx")
    )


def atoms_from_list(spark, names: Sequence[str]) -> DataFrame:
    """D1 from an ordered list of names (position = index); small inputs."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "atom string, idx bigint")


def atoms_from_json(df: DataFrame, col: str) -> DataFrame:
    """A JSON array of names in a string column -> ``(atom, idx)`` by position."""
    arr = F.from_json(F.col(col), "array<string>")
    return df.select(F.posexplode(arr).alias("idx", "atom")).select("atom", F.col("idx").cast("bigint"))


def atoms_from_keys(df: DataFrame, col: str) -> DataFrame:
    """Integer entity keys used directly as indices: ``(atom, idx)``."""
    return df.select(F.col(col).cast("string").alias("atom"), F.col(col).cast("bigint").alias("idx")).distinct()


def to_index(df: DataFrame, atoms: DataFrame, cols: Sequence[str], unknown: str = "drop") -> DataFrame:
    """Replace atom names in ``cols`` by their index.

    Names outside ``atoms`` are dropped with their rows (P1) or, with ``unknown="raise"``, an error (P2).
    """
    if unknown not in ("drop", "raise"):
        raise ValueError("unknown names are either dropped or an error")
    out = df
    for c in cols:
        a = atoms.select(F.col("atom").alias(c), F.col("idx").alias(f"_{c}_idx"))
        if unknown == "raise" and out.join(a, c, "left_anti").limit(1).count():
            raise ValueError(f"column {c} names atoms that are not in the universe")
        out = out.join(a, c).drop(c).withColumnRenamed(f"_{c}_idx", c)
    return out


def universe(names: DataFrame | None = None, semantic_names: DataFrame | None = None) -> DataFrame:
    """``(atom, idx)`` from explicit names, else from those of the semantic input.

    Names with a column ``idx`` keep it; others are numbered in sorted order.
    """
    chosen = names if names is not None else semantic_names
    if chosen is None:
        raise ValueError("an atom universe needs explicit names or a semantic input with names")
    if "idx" in chosen.columns:
        return chosen.select("atom", F.col("idx").cast("bigint").alias("idx"))
    return index_atoms(chosen, "atom")
