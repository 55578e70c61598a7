"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, filter_audit, html_extract, line_dedup, paragraph_minhash, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash_dedup,
    suffix_dedup, token_align, toxicity,
)
from .oracles import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_minhash.repeated_paragraphs(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_equal", "n_near", "text")


def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "width", "distance", "similarity")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def piece_model(path: str | None = None) -> bytes:
    """The bytes of a SentencePiece model; by default the public 32k BPE model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode_documents(docs, piece_model(), outputs=(*sentencepiece_codec.DIGESTS, "spans_sha256"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def bpe_vocabulary(path: str | None = None) -> bytes:
    """The bytes of a byte-level BPE file; by default the public 50k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_documents(table(spark, sf_dir, "documents"), bpe_vocabulary(), piece_model())


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_paragraph_minhash,
        op2_minimax_sharding,
        op3_simhash_decontamination,
        op4_simhash_near_dedup,
        op5_line_dedup,
        op6_distribution_divergence,
        op7_html_tree_scoring,
        op8_suffix_dedup,
        op9_sentencepiece_codec,
        op10_secret_ownership,
        op11_token_alignment,
        op12_toxicity,
        op13_filter_interaction_audit,
    )
}
