"""Registered queries over the driver's tables, one per operator family.

Each entry is ``(spark, sf_dir) -> DataFrame`` and, where the operator is
expressible in SQL, a DuckDB text in :mod:`strata.oracle` with the same column
names.  Doubles are rounded to 6 decimals on both sides.

Entities used:

* documents (``doc_id``) with TF-IDF of their whole text;
* parts (``p_partkey``) with order-adjacency edges (R1 over ``lineitem``),
  customer purchase-sequence edges (R1 over ``orders`` joined to ``lineitem``)
  and TF-IDF of ``p_name``;
* nations with trade edges (supplier nation -> customer nation, R2);
* event types with user traces (R1 over ``events``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as Q
from .functions.prefix import cosine_at_least
from .functions.similarity import (
    call_similarity, combine_similarities, cosine_similarity, cousage_similarity, incoming)
from .operators.contract import aggregate_vectors, contract_edges
from .operators.dbscan import dbscan_labels, neighbour_counts, neighbour_counts_cliques, neighbours
from .operators.outliers import tag_outlier_intervals, tag_outliers
from .plans.analyses import CallAnalysis, CombinedAnalysis, TermAnalysis
from .operators.project import project
from .plans.decompose import cluster, cluster_from_scratch, cluster_step
from .plans.outputs import decomposition_table, layer_blocks, layers_wide, partition_blocks, partitions
from .plans.pipeline import decompose
from .session import cut, ensure_checkpoint_dir
from .sources.derive import atoms_from_keys, index_atoms, relation_edges, tfidf, trace_edges, word_counts
from .sources.readers import unpivot_matrix

R6 = 6  # decimals kept in double outputs (fixed)

# Parameters of the registered queries (fixed values).
DOC_COSINE_FLOOR = 0.8
DOC_DBSCAN_EPS = 0.2
TRADE_DBSCAN_EPS = 0.995
PART_BRAND_EPS = 0.95
PART_COMBINED_FLOOR = 0.5
LADDER_MAX_EPS = 0.15
LADDER_STEP = 0.05
# The radii of that ladder, written out for the oracle.
LADDER_RADII = [1e-10, 0.0500000001, 0.1000000001]
MIN_SAMPLES = 2
SCRATCH_EPS, SCRATCH_MIN_SAMPLES = 0.3, 3
COUSAGE_REACH = 0.95
MIXED_WEIGHTS, MIXED_REACH = [-0.6, 1.6], 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _r(c: str):
    return F.round(F.col(c), R6).alias(c)


# --- derived inputs --------------------------------------------------------------------------

def _tfidf_of(spark, sf_dir, name, key, text, kept=True):
    """Word counts materialised once (tokenising is the expensive pass), then TF-IDF, ``kept`` for several readers."""
    ensure_checkpoint_dir(spark)
    wc = cut(word_counts(table(spark, sf_dir, name), key, text))
    return tfidf(wc, kept=kept)


def doc_tfidf(spark, sf_dir, kept=True):
    return _tfidf_of(spark, sf_dir, "documents", "doc_id", "text", kept)


def part_tfidf(spark, sf_dir):
    return _tfidf_of(spark, sf_dir, "part", "p_partkey", "p_name")


def order_adjacency(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return trace_edges(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")


def customer_sequence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return trace_edges(
        j, "o_custkey", ["o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_partkey"
    )


def trade_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(F.col("s_nationkey").cast("bigint").alias("sn"), F.col("c_nationkey").cast("bigint").alias("cn"))
    )
    return relation_edges(j, "sn", "cn")


def brand_seeds(spark, sf_dir):
    """``(idx, cid)``: every part in the cluster of its brand (cid = smallest key)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    low = p.groupBy("p_brand").agg(F.min("p_partkey").alias("cid"))
    return p.join(low, "p_brand").select(F.col("p_partkey").alias("idx"), "cid")


def source_seeds(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    low = d.groupBy("source").agg(F.min("doc_id").alias("cid"))
    return d.join(low, "source").select(F.col("doc_id").alias("idx"), "cid")


def customer_brand_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    seeds = brand_seeds(spark, sf_dir)
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(seeds, li.l_partkey == seeds.idx)
    return relation_edges(j, "o_custkey", "cid")


def _nodes(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).cast("bigint").alias("node")).distinct()


# --- queries ---------------------------------------------------------------------------------

def q_event_trace_edges(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return trace_edges(ev, "user_id", ["ts", "event_id"], "event_type")


def q_order_adjacency(spark, sf_dir):
    return order_adjacency(spark, sf_dir)


def q_customer_sequence(spark, sf_dir):
    return customer_sequence(spark, sf_dir)


def q_trade_edges(spark, sf_dir):
    return trade_edges(spark, sf_dir)


def q_incoming_parts(spark, sf_dir):
    return incoming(order_adjacency(spark, sf_dir)).select("node", _r("w_in"))


def q_call_sim_trade(spark, sf_dir):
    return call_similarity(trade_edges(spark, sf_dir)).select("i", "j", _r("sim"))


def q_call_sim_parts(spark, sf_dir):
    return call_similarity(order_adjacency(spark, sf_dir)).select("i", "j", _r("sim"))


def q_cousage_trade(spark, sf_dir):
    return cousage_similarity(trade_edges(spark, sf_dir)).select("i", "j", _r("sim"))


def q_cousage_brands(spark, sf_dir):
    return cousage_similarity(customer_brand_edges(spark, sf_dir)).select("i", "j", _r("sim"))


def q_word_counts(spark, sf_dir):
    return word_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


def q_tfidf(spark, sf_dir):
    return doc_tfidf(spark, sf_dir, kept=False).select("idx", "term", _r("x"))


def q_cosine_docs(spark, sf_dir):
    v = doc_tfidf(spark, sf_dir).withColumnRenamed("idx", "node")
    sim = cosine_at_least(v, DOC_COSINE_FLOOR)
    return sim.where(F.col("sim") >= DOC_COSINE_FLOOR).select("i", "j", _r("sim"))


def q_contract_parts_brand(spark, sf_dir):
    return contract_edges(order_adjacency(spark, sf_dir), brand_seeds(spark, sf_dir)).select("src", "dst", _r("w"))


def q_mean_vectors_source(spark, sf_dir):
    return aggregate_vectors(doc_tfidf(spark, sf_dir, kept=False).withColumnRenamed("idx", "node"), source_seeds(spark, sf_dir),
                             "mean").select("node", "term", _r("x"))


def q_sum_vectors_source(spark, sf_dir):
    return aggregate_vectors(doc_tfidf(spark, sf_dir, kept=False).withColumnRenamed("idx", "node"), source_seeds(spark, sf_dir),
                             "sum").select("node", "term", _r("x"))


def q_unpivot_trade(spark, sf_dir):
    e = trade_edges(spark, sf_dir).withColumn("dst", F.concat(F.lit("n"), F.col("dst").cast("string")))
    wide = e.groupBy("src").pivot("dst").agg(F.first("w"))
    return unpivot_matrix(wide, "src", "calls").select(F.col("src").cast("bigint").alias("src"), "dst", "w")


def q_layers_wide_regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    atoms = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("atom"),
                     F.col("n_nationkey").cast("bigint").alias("idx"))
    low = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("cid"))
    region = n.join(low, "n_regionkey").select(F.col("n_nationkey").cast("bigint").alias("idx"),
                                                F.col("cid").cast("bigint"))
    layers = atoms.select(F.lit(0).alias("layer"), "idx", F.col("idx").alias("cid")).unionByName(
        region.select(F.lit(1).alias("layer"), "idx", "cid")
    )
    return layers_wide(layers, atoms)


def _dbscan_one(sim, nodes, eps):
    return dbscan_labels(sim, nodes, eps, MIN_SAMPLES, noise=-1).select(
        F.col("node").alias("idx"), F.col("label").alias("cid")
    )


def q_neighbour_counts_docs(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    v = doc_tfidf(spark, sf_dir).withColumnRenamed("idx", "node")
    sim = cosine_at_least(v, 1.0 - DOC_DBSCAN_EPS)
    return neighbour_counts(neighbours(sim, DOC_DBSCAN_EPS), MIN_SAMPLES)


def q_dbscan_docs(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    v = doc_tfidf(spark, sf_dir).withColumnRenamed("idx", "node")
    sim = cut(cosine_at_least(v, 1.0 - DOC_DBSCAN_EPS, enough=MIN_SAMPLES))
    return _dbscan_one(sim, _nodes(v, "node"), DOC_DBSCAN_EPS)


def q_dbscan_trade(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    e = trade_edges(spark, sf_dir)
    nodes = _nodes(e, "src").unionByName(_nodes(e, "dst")).distinct()
    return _dbscan_one(cut(call_similarity(e)), nodes, TRADE_DBSCAN_EPS)


def q_projection_parts(spark, sf_dir):
    """One seeded step on parts with p_size <= 25 supported,
    seeded by brand; unsupported parts ride along with their brand."""
    ensure_checkpoint_dir(spark)
    part = table(spark, sf_dir, "part")
    atoms = part.select(F.col("p_partkey").alias("idx"))
    support = part.where(F.col("p_size") <= 25).select(F.col("p_partkey").alias("idx"))
    a = CallAnalysis(order_adjacency(spark, sf_dir), support)
    a.bind(atoms)
    seeds = brand_seeds(spark, sf_dir)
    a.seed(seeds)
    moves, _ = cluster_step(a, seeds, PART_BRAND_EPS, MIN_SAMPLES)
    return project(seeds, moves)


def _part_combined_counts(spark, sf_dir, weights):
    """M5 + P5 + A6: per part, the number of parts (itself included) whose combined
    similarity (order-adjacency call similarity with part-name cosine) is at least
    ``PART_COMBINED_FLOOR``.  Computed by the pruned combined analysis: same-name
    parts are a clique counted by size, never listed pair by pair."""
    ensure_checkpoint_dir(spark)
    part = table(spark, sf_dir, "part")
    atoms = part.select(F.col("p_partkey").alias("idx"))
    sup = atoms
    a = CombinedAnalysis([CallAnalysis(order_adjacency(spark, sf_dir), sup),
                          TermAnalysis(part_tfidf(spark, sf_dir), sup)], weights)
    a.bind(atoms)
    a.seed(atoms.select("idx", F.col("idx").alias("cid")))
    eps = 1.0 - PART_COMBINED_FLOOR
    sim = a.similarity(eps)
    return neighbour_counts_cliques(sim, eps, a.cliques_at(eps), links=a.links_at(eps))


def q_combined_parts_mean(spark, sf_dir):
    return _part_combined_counts(spark, sf_dir, None)


def q_combined_parts_weighted(spark, sf_dir):
    return _part_combined_counts(spark, sf_dir, [0.3, 0.7])


def _doc_ladder(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    v = doc_tfidf(spark, sf_dir)
    atoms = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    run = cluster(atoms, [TermAnalysis(v)], epsilons=[LADDER_MAX_EPS], min_samples=MIN_SAMPLES,
                  epsilon_step=LADDER_STEP, strategy="sequential")
    return run


def q_ladder_docs(spark, sf_dir):
    return _doc_ladder(spark, sf_dir).layers()


def q_layer_intervals_docs(spark, sf_dir):
    return _doc_ladder(spark, sf_dir).intervals()


def q_outlier_intervals_docs(spark, sf_dir):
    return tag_outlier_intervals(_doc_ladder(spark, sf_dir).intervals(), MIN_SAMPLES)


def q_outliers_ladder_docs(spark, sf_dir):
    return tag_outliers(_doc_ladder(spark, sf_dir).layers(), MIN_SAMPLES)


def q_partitions_docs(spark, sf_dir):
    final = _doc_ladder(spark, sf_dir).final()
    atoms = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("atom"),
                                                    F.col("doc_id").alias("idx"))
    return partitions(final, atoms)


def part_inputs(spark, sf_dir):
    """Hybrid inputs on parts: dynamic = order adjacency, structural = customer
    purchase sequence, semantic = TF-IDF of the part name; all parts supported."""
    sup = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))
    return {
        "dynamic": (order_adjacency(spark, sf_dir), sup),
        "structural": (customer_sequence(spark, sf_dir), sup),
        "semantic": (part_tfidf(spark, sf_dir), sup),
    }


def q_hybrid_parts(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    atoms = atoms_from_keys(table(spark, sf_dir, "part"), "p_partkey")
    res = decompose(spark, atoms, part_inputs(spark, sf_dir), pipeline="hybrid", app="parts")
    return res.final


def q_alternating_trade(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    n = table(spark, sf_dir, "nation")
    atoms = n.select(F.col("n_nationkey").cast("bigint").alias("idx"))
    run = cluster(atoms, [CallAnalysis(trade_edges(spark, sf_dir), similarity="cousage"),
                          CallAnalysis(trade_edges(spark, sf_dir))],
                  epsilons=[0.05, TRADE_DBSCAN_EPS], strategy="alternating", max_iterations=10)
    return run.final()


def q_stream_event_edges(spark, sf_dir):
    from .streaming.edges import stream_trace_edges

    ensure_checkpoint_dir(spark)
    return stream_trace_edges(spark, sf_dir, "user_id", ["ts", "event_id"], "event_type", glob="events.parquet")


#: Files that the late stream is written to, and how many of them a row may come late.
STREAM_FILES, STREAM_DELAY = 6, 2


def q_stream_late_event_edges(spark, sf_dir):
    """R6 out of order: the events arrive in six slices of time, every third row one slice late and
    every seventh two, and each micro-batch reads one slice.  Late rows are linked again by keyed state."""
    from .streaming.edges import stream_trace_edges

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/late-events-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                             F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    width = max(1, (last - first) // STREAM_FILES + 1) if first is not None else 1
    lot = F.pmod(F.xxhash64("event_id"), F.lit(21))
    late = F.when(lot % 7 == 0, 2).when(lot % 3 == 0, 1).otherwise(0)
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first)) / F.lit(width))
    placed = events.withColumn("slice", F.least(F.coalesce(at, F.lit(0)) + late, F.lit(STREAM_FILES - 1)).cast("int"))
    for k in range(STREAM_FILES):  # one write after the other: a file source reads files in the order of their times
        placed.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{folder}/rows")
    n_files = len(spark.read.parquet(f"{folder}/rows").inputFiles())
    return stream_trace_edges(spark, f"{folder}/rows", "user_id", ["ts", "event_id"], "event_type", folder=f"{folder}/run",
                              max_files_per_trigger=max(1, n_files // STREAM_FILES),
                              lateness=f"{(STREAM_DELAY + 1) * width // 1_000_000 + 1} seconds")


# --- documents on shelves: several stages, several merging steps --------------------------------

# The radii of the growing schedules with step 0.15 up to 0.65, written out for the oracle.
SHELF_STEP = 0.15
SHELF_RADII = [1e-10, 0.1500000001, 0.3000000001, 0.4500000001, 0.6000000001]
SHELF_PARAMS = {"clustering": {"epsilon_step": SHELF_STEP}}


def shelved(spark, sf_dir):
    """Documents with the atom (language, source, digits of the length) they stand on, and its index."""
    d = table(spark, sf_dir, "documents").withColumn(
        "atom", F.concat_ws("/", "lang", "source", F.length(F.col("n_chars").cast("string")).cast("string")))
    atoms = cut(index_atoms(d, "atom"))
    return d.join(atoms, "atom"), atoms


def shelf_inputs(spark, sf_dir):
    """``dynamic``: sequences by source, English shelves only; ``structural``: sequences by language; ``semantic``."""
    ensure_checkpoint_dir(spark)
    d, atoms = shelved(spark, sf_dir)
    every = atoms.select("idx")
    english = atoms.where(F.col("atom").startswith("en/")).select("idx")
    return atoms, {
        "dynamic": (cut(trace_edges(d.where("lang = 'en'"), "source", ["doc_id"], "idx")), english),
        "structural": (cut(trace_edges(d, "lang", ["doc_id"], "idx")), every),
        "semantic": (cut(tfidf(word_counts(d, "idx", "text"))), every),
    }


def q_index_shelves(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return shelved(spark, sf_dir)[1].select("atom", "idx")


def _shelf_run(spark, sf_dir, pipeline, params=None):
    atoms, inputs = shelf_inputs(spark, sf_dir)
    return atoms, decompose(spark, atoms, inputs, pipeline=pipeline, params=params or SHELF_PARAMS, app="shelves")


def q_hybrid_shelves(spark, sf_dir):
    return _shelf_run(spark, sf_dir, "hybrid")[1].layers


def q_static_shelves(spark, sf_dir):
    return _shelf_run(spark, sf_dir, "static")[1].layers


def q_unequal_shelves(spark, sf_dir):
    params = {"clustering": {"epsilon_step": SHELF_STEP}, "dynamic": {"epsilon": 0.2}}
    return _shelf_run(spark, sf_dir, "hybrid", params)[1].layers


def q_alternating_shelves(spark, sf_dir):
    params = {"clustering": {"strategy": "alternating", "max_iterations": 4}, "semantic": {"epsilon": 0.3},
              "structural": {"epsilon": 0.7}}
    return _shelf_run(spark, sf_dir, ["semantic", "structural"], params)[1].final


def q_scratch_shelves(spark, sf_dir):
    atoms, inputs = shelf_inputs(spark, sf_dir)
    return cluster_from_scratch(TermAnalysis(*inputs["semantic"]), atoms, SCRATCH_EPS, SCRATCH_MIN_SAMPLES)


def q_table_shelves(spark, sf_dir):
    atoms, res = _shelf_run(spark, sf_dir, "static")
    return decomposition_table(res.final, atoms, "shelves", "text", "class")


def q_partition_blocks_shelves(spark, sf_dir):
    atoms, res = _shelf_run(spark, sf_dir, "static")
    return partition_blocks(res.final, atoms, 50).select(
        "partition", "cid", "block", F.array_join("members", ",").alias("members"))


def q_layer_blocks_shelves(spark, sf_dir):
    atoms, res = _shelf_run(spark, sf_dir, "static")
    return layer_blocks(res.layers, 50).select(
        "name", "layer", "block", F.array_join(F.transform("clusters", lambda x: x.cast("string")), ",").alias("clusters"))


def q_combined_values_shelves(spark, sf_dir):
    atoms, inputs = shelf_inputs(spark, sf_dir)
    cos = cosine_similarity(inputs["semantic"][0].withColumnRenamed("idx", "node"))
    return combine_similarities([call_similarity(inputs["structural"][0]), cos], [0.3, 0.7]).select("i", "j", _r("sim"))


def q_combined_mixed_signs_shelves(spark, sf_dir):
    """M5 with a negative weight, through the pruned path: shelves of alike words that trade little."""
    atoms, inputs = shelf_inputs(spark, sf_dir)
    a = CombinedAnalysis([CallAnalysis(*inputs["structural"]), TermAnalysis(*inputs["semantic"])], MIXED_WEIGHTS)
    a.bind(atoms)
    a.seed(atoms.select("idx", F.col("idx").alias("cid")))
    return a.similarity(MIXED_REACH).select("i", "j", _r("sim"))


def q_dbscan_border_docs(spark, sf_dir):
    """With four samples some documents border a cluster without being core."""
    ensure_checkpoint_dir(spark)
    v = doc_tfidf(spark, sf_dir).withColumnRenamed("idx", "node")
    sim = cut(cosine_at_least(v, 1.0 - DOC_DBSCAN_EPS, enough=4))
    return dbscan_labels(sim, _nodes(v, "node"), DOC_DBSCAN_EPS, 4, noise=-1).select(
        F.col("node").alias("idx"), F.col("label").alias("cid"))


def q_projection_some_brands(spark, sf_dir):
    """Brands without any supported part keep their cluster."""
    ensure_checkpoint_dir(spark)
    part = table(spark, sf_dir, "part")
    a = CallAnalysis(order_adjacency(spark, sf_dir),
                     part.where("p_brand < 'Brand#40'").select(F.col("p_partkey").alias("idx")))
    a.bind(part.select(F.col("p_partkey").alias("idx")))
    seeds = brand_seeds(spark, sf_dir)
    a.seed(seeds)
    moves, _ = cluster_step(a, seeds, PART_BRAND_EPS, MIN_SAMPLES)
    return project(seeds, moves)


def q_pruned_cousage_customers(spark, sf_dir):
    """M2 with a floor: customers who bought the same parts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    edges = relation_edges(li.join(o, li.l_orderkey == o.o_orderkey), "l_partkey", "o_custkey")
    return cousage_similarity(edges, reach=COUSAGE_REACH).select("i", "j", _r("sim"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "r1_event_trace_edges": q_event_trace_edges,
    "r1_order_adjacency_edges": q_order_adjacency,
    "r1_customer_sequence_edges": q_customer_sequence,
    "r2_trade_edges": q_trade_edges,
    "a5_incoming_parts": q_incoming_parts,
    "m1_call_similarity_trade": q_call_sim_trade,
    "m1_call_similarity_parts": q_call_sim_parts,
    "m2_cousage_trade": q_cousage_trade,
    "m2_cousage_brands": q_cousage_brands,
    "r3_word_counts_docs": q_word_counts,
    "r4_tfidf_docs": q_tfidf,
    "m3_cosine_docs": q_cosine_docs,
    "a1_contract_parts_brand": q_contract_parts_brand,
    "a2_mean_vectors_source": q_mean_vectors_source,
    "a3_sum_vectors_source": q_sum_vectors_source,
    "s7_unpivot_trade": q_unpivot_trade,
    "w1_layers_wide_regions": q_layers_wide_regions,
    "a6_neighbour_counts_docs": q_neighbour_counts_docs,
    "c1_dbscan_docs": q_dbscan_docs,
    "c1_dbscan_trade": q_dbscan_trade,
    "c5_projection_parts": q_projection_parts,
    "m5_combined_parts_mean": q_combined_parts_mean,
    "m5_combined_parts_weighted": q_combined_parts_weighted,
    "c9_ladder_docs": q_ladder_docs,
    "c11_outliers_ladder_docs": q_outliers_ladder_docs,
    "c10_layer_intervals_docs": q_layer_intervals_docs,
    "c11_outlier_intervals_docs": q_outlier_intervals_docs,
    "a9_partitions_docs": q_partitions_docs,
    "k1_hybrid_parts": q_hybrid_parts,
    "c7_alternating_trade": q_alternating_trade,
    "r6_stream_event_edges": q_stream_event_edges,
    "r6_stream_late_event_edges": q_stream_late_event_edges,
    "r5_index_shelves": q_index_shelves,
    "k1_hybrid_shelves": q_hybrid_shelves,
    "k2_static_shelves": q_static_shelves,
    "c8_unequal_shelves": q_unequal_shelves,
    "c7_alternating_shelves": q_alternating_shelves,
    "c6_scratch_shelves": q_scratch_shelves,
    "w4_table_shelves": q_table_shelves,
    "a9_blocks_shelves": q_partition_blocks_shelves,
    "w5_blocks_shelves": q_layer_blocks_shelves,
    "m5_values_shelves": q_combined_values_shelves,
    "m5_mixed_signs_shelves": q_combined_mixed_signs_shelves,
    "j8_border_docs": q_dbscan_border_docs,
    "j7_projection_some_brands": q_projection_some_brands,
    "m2_pruned_customers": q_pruned_cousage_customers,
}


# --- oracle SQL ------------------------------------------------------------------------------

def _round(sql: str, cols: str, dcol: str) -> str:
    return f"SELECT {cols}, round({dcol}, 6) AS {dcol} FROM ({sql})"


def _ladder_sql() -> str:
    return Q.term_ladder(Q.DOC_TFIDF, "SELECT doc_id AS idx FROM documents", LADDER_RADII, MIN_SAMPLES)


def oracle() -> dict[str, str]:
    doc_vec = f"SELECT idx AS node, term, x FROM ({Q.DOC_TFIDF})"
    part_vec = f"SELECT idx AS node, term, x FROM ({Q.PART_TFIDF})"
    ladder = _ladder_sql()
    brand = "SELECT p.p_partkey AS idx, b.cid FROM part p JOIN (SELECT p_brand, min(p_partkey) AS cid FROM part GROUP BY p_brand) b USING (p_brand)"
    source = "SELECT d.doc_id AS idx, s.cid FROM documents d JOIN (SELECT source, min(doc_id) AS cid FROM documents GROUP BY source) s USING (source)"
    trade_nodes = f"SELECT DISTINCT src AS node FROM ({Q.TRADE_EDGES}) UNION SELECT DISTINCT dst FROM ({Q.TRADE_EDGES})"
    doc_sim = f"SELECT * FROM ({Q.cosine_similarity(doc_vec)}) WHERE sim >= {Q.dbl(1.0 - DOC_DBSCAN_EPS - 1e-9)}"
    # Supported parts (p_size <= 25), edges restricted to them, contracted by brand seeds
    sup_edges = (
        f"SELECT e.* FROM ({Q.ORDER_ADJACENCY}) e JOIN part a ON a.p_partkey = e.src AND a.p_size <= 25 "
        f"JOIN part b ON b.p_partkey = e.dst AND b.p_size <= 25"
    )
    contracted = (
        f"SELECT si.cid AS src, sj.cid AS dst, sum(e.w) AS w FROM ({sup_edges}) e "
        f"JOIN ({brand}) si ON si.idx = e.src JOIN ({brand}) sj ON sj.idx = e.dst GROUP BY ALL HAVING sum(e.w) <> 0"
    )
    sup_nodes = f"SELECT DISTINCT s.cid AS node FROM ({brand}) s JOIN part p ON p.p_partkey = s.idx AND p.p_size <= 25"
    proj = f"""
    WITH RECURSIVE {Q.dbscan_ctes('d', Q.call_similarity(contracted), sup_nodes, PART_BRAND_EPS, MIN_SAMPLES)}
    SELECT s.idx, coalesce(m.new, s.cid) AS cid FROM ({brand}) s LEFT JOIN d_moves m ON m.node = s.cid
    """
    shelf_in = {"dynamic": Q.SHELF_BY_SOURCE, "structural": Q.SHELF_BY_LANG, "semantic": Q.SHELF_TFIDF}
    both = [("call", "structural"), ("cosine", "semantic")]
    run = lambda stages, plan: Q.layers_of_plan(shelf_in, Q.SHELVES, stages, plan, MIN_SAMPLES)
    hybrid_plan = [(k, e) for e in SHELF_RADII for k in (0, 1)]
    static_plan = [(0, e) for e in SHELF_RADII]
    unequal_plan = [(k, min(e, 0.2) if k == 0 else e) for k, e in hybrid_plan]
    static = run([both], static_plan)
    last = f"WITH RECURSIVE {static}\n"
    turns = [(k, (0.3, 0.7)[k]) for _ in range(4) for k in (0, 1)]
    some_edges = (
        f"SELECT e.* FROM ({Q.ORDER_ADJACENCY}) e JOIN part a ON a.p_partkey = e.src AND a.p_brand < 'Brand#40' "
        f"JOIN part b ON b.p_partkey = e.dst AND b.p_brand < 'Brand#40'")
    some_contracted = (
        f"SELECT si.cid AS src, sj.cid AS dst, sum(e.w) AS w FROM ({some_edges}) e "
        f"JOIN ({brand}) si ON si.idx = e.src JOIN ({brand}) sj ON sj.idx = e.dst GROUP BY ALL HAVING sum(e.w) <> 0")
    bought = ("SELECT DISTINCT l.l_partkey AS src, o.o_custkey AS dst, 1.0 AS w FROM lineitem l "
              "JOIN orders o ON l.l_orderkey = o.o_orderkey")
    comb_mean = Q.combined([Q.call_similarity(Q.ORDER_ADJACENCY), Q.cosine_similarity(part_vec)], [0.5, 0.5])
    comb_w = Q.combined([Q.call_similarity(Q.ORDER_ADJACENCY), Q.cosine_similarity(part_vec)], [0.3, 0.7])
    return {
        "r1_event_trace_edges": Q.trace_edges("events", "user_id", ["ts", "event_id"], "event_type", cast=None),
        "r1_order_adjacency_edges": Q.ORDER_ADJACENCY,
        "r1_customer_sequence_edges": Q.CUSTOMER_SEQUENCE,
        "r2_trade_edges": Q.TRADE_EDGES,
        "a5_incoming_parts": f"SELECT dst AS node, round(sum(w), 6) AS w_in FROM ({Q.ORDER_ADJACENCY}) GROUP BY dst",
        "m1_call_similarity_trade": _round(Q.call_similarity(Q.TRADE_EDGES), "i, j", "sim"),
        "m1_call_similarity_parts": _round(Q.call_similarity(Q.ORDER_ADJACENCY), "i, j", "sim"),
        "m2_cousage_trade": _round(Q.cousage_similarity(Q.TRADE_EDGES), "i, j", "sim"),
        "m2_cousage_brands": _round(Q.cousage_similarity(Q.CUSTOMER_BRAND_EDGES), "i, j", "sim"),
        "r3_word_counts_docs": Q.DOC_WORDS,
        "r4_tfidf_docs": _round(Q.DOC_TFIDF, "idx, term", "x"),
        "m3_cosine_docs": _round(
            f"SELECT * FROM ({Q.cosine_similarity(doc_vec)}) WHERE sim >= {Q.dbl(DOC_COSINE_FLOOR)}", "i, j", "sim"
        ),
        "a1_contract_parts_brand": (
            f"SELECT si.cid AS src, sj.cid AS dst, round(sum(e.w), 6) AS w FROM ({Q.ORDER_ADJACENCY}) e "
            f"JOIN ({brand}) si ON si.idx = e.src JOIN ({brand}) sj ON sj.idx = e.dst GROUP BY ALL"
        ),
        "a2_mean_vectors_source": (
            f"SELECT s.cid AS node, v.term, round(sum(v.x) / max(c.n), 6) AS x FROM ({Q.DOC_TFIDF}) v "
            f"JOIN ({source}) s USING (idx) JOIN (SELECT cid, count(*) AS n FROM ({source}) GROUP BY cid) c "
            f"ON c.cid = s.cid GROUP BY s.cid, v.term"
        ),
        "a3_sum_vectors_source": (
            f"SELECT s.cid AS node, v.term, round(sum(v.x), 6) AS x FROM ({Q.DOC_TFIDF}) v "
            f"JOIN ({source}) s USING (idx) GROUP BY s.cid, v.term"
        ),
        "s7_unpivot_trade": f"SELECT src, 'n' || CAST(dst AS VARCHAR) AS dst, w FROM ({Q.TRADE_EDGES}) WHERE w <> 0",
        "w1_layers_wide_regions": wide_regions_sql(),
        "a6_neighbour_counts_docs": (
            f"SELECT i AS node, count(*) AS n_neighbours, count(*) >= {MIN_SAMPLES} AS core FROM ({doc_sim}) "
            f"WHERE {Q.dist('sim')} <= {Q.dbl(DOC_DBSCAN_EPS)} GROUP BY i"
        ),
        "c1_dbscan_docs": Q.dbscan_labels(doc_sim, f"SELECT DISTINCT node FROM ({doc_vec})", DOC_DBSCAN_EPS, MIN_SAMPLES),
        "c1_dbscan_trade": Q.dbscan_labels(Q.call_similarity(Q.TRADE_EDGES), trade_nodes, TRADE_DBSCAN_EPS, MIN_SAMPLES),
        "c5_projection_parts": proj,
        "m5_combined_parts_mean": (
            f"SELECT i AS node, count(*) AS n_neighbours FROM ({comb_mean}) "
            f"WHERE {Q.dist('sim')} <= {Q.dbl(1.0 - PART_COMBINED_FLOOR)} GROUP BY i"
        ),
        "m5_combined_parts_weighted": (
            f"SELECT i AS node, count(*) AS n_neighbours FROM ({comb_w}) "
            f"WHERE {Q.dist('sim')} <= {Q.dbl(1.0 - PART_COMBINED_FLOOR)} GROUP BY i"
        ),
        "c9_ladder_docs": ladder,
        "c10_layer_intervals_docs": (
            f"SELECT idx, cid, min(layer) AS first_layer, max(layer) AS last_layer FROM ({ladder}) GROUP BY idx, cid"
        ),
        "c11_outlier_intervals_docs": (
            f"WITH l AS ({ladder}), t AS (SELECT layer, idx, cid, count(*) OVER (PARTITION BY layer, cid) < {MIN_SAMPLES} "
            f"AS small FROM l) SELECT idx, CASE WHEN small THEN CAST(-1 AS BIGINT) ELSE cid END AS cid, "
            f"min(layer) AS first_layer, max(layer) AS last_layer FROM t GROUP BY idx, t.cid, small"
        ),
        "c11_outliers_ladder_docs": (
            f"WITH l AS ({ladder}) SELECT layer, idx, CASE WHEN count(*) OVER (PARTITION BY layer, cid) < {MIN_SAMPLES} "
            f"THEN CAST(-1 AS BIGINT) ELSE cid END AS cid FROM l"
        ),
        "a9_partitions_docs": (
            f"WITH l AS ({ladder}) SELECT 'partition' || CAST(cid AS VARCHAR) AS partition, cid, idx, "
            f"CAST(idx AS VARCHAR) AS atom FROM l WHERE layer = (SELECT max(layer) FROM l)"
        ),
        "r5_index_shelves": Q.SHELVES,
        "k1_hybrid_shelves": Q.all_layers(run([[("call", "dynamic")], both], hybrid_plan), len(hybrid_plan)),
        "k2_static_shelves": Q.all_layers(static, len(static_plan)),
        "c8_unequal_shelves": Q.all_layers(run([[("call", "dynamic")], both], unequal_plan), len(unequal_plan)),
        "c7_alternating_shelves": (
            "WITH RECURSIVE " + run([[("cosine", "semantic")], [("call", "structural")]], turns)
            + f"\nSELECT idx, cid FROM a{len(turns)}"),
        "c6_scratch_shelves": Q.dbscan_labels(
            Q.cosine_similarity(f"SELECT idx AS node, term, x FROM ({Q.SHELF_TFIDF})"),
            f"SELECT idx AS node FROM ({Q.SHELVES})", SCRATCH_EPS, SCRATCH_MIN_SAMPLES),
        "w4_table_shelves": last + (
            f"SELECT 'shelves' AS app, 'text' AS language, 'class' AS level, 'partition' || CAST(a.cid AS VARCHAR) AS partition, "
            f"a.cid, a.idx, n.atom FROM a{len(static_plan)} a JOIN ({Q.SHELVES}) n USING (idx)"),
        "a9_blocks_shelves": last + (
            f"SELECT 'partition' || CAST(a.cid AS VARCHAR) AS partition, a.cid, a.idx // 50 AS block, "
            f"string_agg(n.atom, ',' ORDER BY a.idx) AS members FROM a{len(static_plan)} a JOIN ({Q.SHELVES}) n USING (idx) "
            f"GROUP BY a.cid, a.idx // 50"),
        "w5_blocks_shelves": (
            f"SELECT 'layer_' || CAST(layer AS VARCHAR) AS name, layer, idx // 50 AS block, "
            f"string_agg(CAST(cid AS VARCHAR), ',' ORDER BY idx) AS clusters "
            f"FROM ({Q.all_layers(static, len(static_plan))}) GROUP BY layer, idx // 50"),
        "m5_mixed_signs_shelves": _round(
            "SELECT * FROM (" + Q.combined(
                [Q.call_similarity(Q.SHELF_BY_LANG),
                 Q.cosine_similarity(f"SELECT idx AS node, term, x FROM ({Q.SHELF_TFIDF})")], MIXED_WEIGHTS)
            + f") WHERE {Q.dist('sim')} <= {MIXED_REACH}", "i, j", "sim"),
        "m5_values_shelves": _round(Q.combined(
            [Q.call_similarity(Q.SHELF_BY_LANG),
             Q.cosine_similarity(f"SELECT idx AS node, term, x FROM ({Q.SHELF_TFIDF})")], [0.3, 0.7]), "i, j", "sim"),
        "j8_border_docs": Q.dbscan_labels(doc_sim, f"SELECT DISTINCT node FROM ({doc_vec})", DOC_DBSCAN_EPS, 4),
        "j7_projection_some_brands": f"""
    WITH RECURSIVE {Q.dbscan_ctes('d', Q.call_similarity(some_contracted), '', PART_BRAND_EPS, MIN_SAMPLES)}
    SELECT s.idx, coalesce(m.new, s.cid) AS cid FROM ({brand}) s LEFT JOIN d_moves m ON m.node = s.cid
    """,
        "m2_pruned_customers": _round(
            f"SELECT * FROM ({Q.cousage_similarity(bought)}) WHERE {Q.dist('sim')} <= {Q.dbl(COUSAGE_REACH)}", "i, j", "sim"),
        "r6_stream_event_edges": Q.trace_edges("events", "user_id", ["ts", "event_id"], "event_type", cast=None),
        "r6_stream_late_event_edges": Q.trace_edges("events", "user_id", ["ts", "event_id"], "event_type", cast=None),
    }


def wide_regions_sql(n_nations: int = 25) -> str:
    """W1 oracle: columns ``n0 .. n{N-1}`` (the fixed 25 nation keys of the schema)."""
    cols = ", ".join(
        f"max(CASE WHEN n.n_nationkey = {k} THEN CASE WHEN l.layer = 0 THEN CAST(n.n_nationkey AS BIGINT) "
        f"ELSE r.cid END END) AS n{k}"
        for k in range(n_nations)
    )
    return (
        f"SELECT 'layer ' || CAST(l.layer AS VARCHAR) AS layer, {cols} FROM nation n "
        f"JOIN (SELECT n_regionkey, min(CAST(n_nationkey AS BIGINT)) AS cid FROM nation GROUP BY n_regionkey) r "
        f"USING (n_regionkey) CROSS JOIN (SELECT 0 AS layer UNION ALL SELECT 1) l GROUP BY l.layer"
    )
