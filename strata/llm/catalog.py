"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.fim_frames import fill_in_middle, frame_texts, plan_cuts
from strata.llm.html_extract import extract_main_text
from strata.llm.inverted_multi_index import search
from strata.llm.kneser_ney import perplexity_filter
from strata.llm.line_dedup import EXACT_CHARS, MAX_EDITS, repeated_lines
from strata.llm.mixing import mix_documents, word_sizes
from strata.llm.piece_transducer import encode_decode
from strata.llm.prob_minhash import near_duplicate_classes
from strata.llm.quality_rules import quality_rules
from strata.llm.simhash import simhash_components
from strata.llm.token_alignment import align_tokenizers
from strata.llm.token_counts import LIMIT_TOKENS, count_tokens
from strata.llm.warc_revisits import ORACLE as WARC_ORACLE
from strata.llm.warc_revisits import captures_of_pages, resolve_revisits
from strata.session import cut, ensure_checkpoint_dir, spread


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op4_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), carry=["doc_id"])


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(captures_of_pages(_table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return resolved.select(
        "record_id", "url", "canonical", "full_id", "verdict", header("etag").alias("etag"),
        header("cache-control").alias("cache_control"), header("content-type").alias("content_type"),
        header("server").alias("server"))


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = word_sizes(docs, "text", "size", ["doc_id", "source"])
    return mix_documents(sized, "doc_id").select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counted = count_tokens(docs, tokenizer_file("word_bpe_49k.json"), carry=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT_TOKENS)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(_table(spark, sf_dir, "documents"), exact_chars=EXACT_CHARS, max_edits=MAX_EDITS)
    return found.withColumn("n_dropped", F.size("dropped").cast("long"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity_filter(_table(spark, sf_dir, "documents"), trusted).select(
        "doc_id", "code", "trusted", "n_words", "n_symbols", "perplexity", "threshold", "kept")


def op11_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = cut(frame_texts(docs, carry=["doc_id"]))
    return fill_in_middle(plan_cuts(stored, "doc_id"), ["doc_id"])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
                            tokenizer_file("piece_bpe_32k.model"), carry=["doc_id"])


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_prob_minhash": op2_prob_minhash,
    "op3_inverted_multi_index": op3_inverted_multi_index,
    "op4_piece_transducer": op4_piece_transducer,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_entropy_mix": op6_entropy_mix,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_fim_frames": op11_fim_frames,
    "op12_token_alignment": op12_token_alignment,
    "op13_simhash": op13_simhash,
}

ORACLE: dict[str, str] = {
    "op5_warc_revisits": WARC_ORACLE,
}
