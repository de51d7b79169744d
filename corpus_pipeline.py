"""Corpus pipeline: five stages over ``documents``, each stage's Parquet output read by the next.

1. ``quality_rules``: documents that the rules reject go (operator 7);
2. ``line_dedup``: lines that repeat an earlier line go (operator 9);
3. ``near_duplicates``: one document of each near-duplicate class stays (operator 2);
4. ``mixture``: sources are mixed to their target weights, a document appears as often as its copies (operator 6);
5. ``tokens``: texts are encoded to piece ids and decoded again (operator 4).

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.catalog import tokenizer_file
from strata.llm.line_dedup import EXACT_CHARS, MAX_EDITS, drop_repeated_lines
from strata.llm.mixing import mix_documents, word_sizes
from strata.llm.piece_transducer import encode_decode
from strata.llm.prob_minhash import keep_one_per_class
from strata.llm.quality_rules import quality_rules
from strata.llm.schema_safe import own_name
from strata.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return quality_rules(docs).where("kept").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return drop_repeated_lines(docs, exact_chars=EXACT_CHARS, max_edits=MAX_EDITS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return keep_one_per_class(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its copies; one whose copies are 0 is not in the mix.

    Rows that repeat a ``doc_id`` (null included) are copied alike, by the most that one of them gets.
    """
    ensure_checkpoint_dir(spark)
    mix = mix_documents(word_sizes(docs.select("doc_id", "source", "text"), "text", "size", ["doc_id", "source"]), "doc_id")
    key, times = own_name(docs, "mixed_id", "mixed_copies")
    copies = mix.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(times)).where(F.col(times) > 0)
    rows = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(key)))
    (turn,) = own_name(rows, "mixed_turn")
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), carry=["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("tokens", token_stage),
]

#: Signatures, the convex dual and the transducer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage returns is written next to the checkpoints and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
