"""A training-data pipeline over ``documents``, built of the operators in tracefold.llm.

Each stage works on all rows that the one before kept. Documents that quality rules reject
go; near-equal lines go from the texts that stay; of near-duplicates one document stays; what
holds a benchmark item goes; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._shared import discard, materialize
from tracefold.llm.decontaminate import drop_leaking
from tracefold.llm.line_dedup import dedup_lines
from tracefold.llm.quality_rules import keep_good
from tracefold.llm.queries import piece_model, table
from tracefold.llm.sentencepiece_codec import DIGESTS, encode_documents
from tracefold.llm.simhash_dedup import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the rules reject go.

    Null and empty texts are rejected (too few words). Repeated rows are judged alike. Extra columns
    stay. An empty table stays empty.
    """
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines equal or nearly equal to an earlier one go; n_chars follows the text.

    Every row stays, also one whose text is left empty. A null text stays null, with null n_chars.
    Repeated rows (id and text) count as one document and are cut alike. Extra columns stay.
    """
    return dedup_lines(docs, counts=None).select(
        *[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, whatever its id.

    Null and empty texts form one group. Of a row that is repeated one stays. Null ids and equal ids
    of unlike texts keep their documents apart. Extra columns stay.
    """
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go.

    Null and empty texts hold none and stay. Repeated rows go or stay together. Extra columns stay.
    With an empty benchmark table all rows stay.
    """
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding of every text that is left, a row per row.

    A null text counts as empty: no tokens. Extra columns do not appear in the result.
    """
    return encode_documents(docs, piece_model(), keep=("doc_id", "lang", "source"), outputs=DIGESTS)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece_codec", encode),
]

#: SQL expresses neither the edit join nor the encoding; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again, then deleted."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = written[:]
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", written)
        discard(spark, before)
        written = written[len(before):]
    return docs
