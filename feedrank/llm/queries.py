"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import register
from ..sources.tables import read
from . import conversation_repair, maxent_lm, quality_model, quality_rules
from .html_text import extract
from .jaccard_join import jaccard_components
from .merge_dropout import piece_path, roundtrip
from .packing import retrieval_pack
from .paragraph_sketch import fingerprints
from .token_files import token_files
from .spaced_bpe import word_bpe_path
from .vector_packing import vector_pack
from .warc import archive
from .whitening import whiten
from .wordbpe import byte_bpe_path


@register("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from ``labels.quality`` outside fold 0."""
    return quality_model.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval packing of all documents into windows of 2048 ids."""
    return retrieval_pack(read(spark, sf_dir, "documents"), byte_bpe_path(), end_id=1, window=2048)


@register("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph sketches of every document and of its edited text, and their likeness."""
    return fingerprints(read(spark, sf_dir, "documents"))


@register("op4_merge_dropout")
def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge dropout and decoded again (length and digest of the decoded text)."""
    return roundtrip(read(spark, sf_dir, "documents"), piece_path(), seed=17, rate=0.1)


@register("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 3-word shingle sets with Jaccard similarity of at least 0.9."""
    return jaccard_components(read(spark, sf_dir, "documents"), size=3, percent=90)


@register("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in key order, read back."""
    return token_files(read(spark, sf_dir, "documents"), byte_bpe_path(), end_id=0)


@register("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document."""
    return maxent_lm.score_documents(read(spark, sf_dir, "documents"), folds=5, held_out_fold=1)


@register("op9_quality_rules", quality_rules.oracle())
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document with thresholds per language and source."""
    return quality_rules.score_documents(read(spark, sf_dir, "documents"))


@register("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by composite text density."""
    return extract(read(spark, sf_dir, "pages"))


_OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@register("op10_warc", _OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, indexed by merging sorted runs, and read back through the index."""
    return archive(read(spark, sf_dir, "pages"), least_bytes=100).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op11_conversation_repair", conversation_repair.ORACLE)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired digest of every damaged conversation."""
    return conversation_repair.repair_conversations(read(spark, sf_dir, "conversations"))


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector, with the fit's figures."""
    return whiten(read(spark, sf_dir, "embeddings"), most=32)


@register("op13_vector_packing")
def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector best-fit packing of all documents into sequences of at most 2048 ids."""
    pieces = vector_pack(read(spark, sf_dir, "documents"), word_bpe_path(), end_id=0, window=2048,
                         weights=(1.0, 0.1, 0.1))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
