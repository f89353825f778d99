"""The corpus pipeline: quality rules, quality classifier, near duplicates, packing.

``STAGES`` lists the stages in order.  Each is a function ``(spark, docs,
sf_dir) -> DataFrame``; its result is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``;
each works on all that its predecessor kept.  It belongs to ``feedrank.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedrank.llm import jaccard_join, packing, quality_model, quality_rules, wordbpe
from feedrank.operators.lineage import cut
from feedrank.plans.registry import register
from feedrank.session import ship_package
from feedrank.sources.tables import read


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the adaptive thresholds reject."""
    ship_package(spark)
    return quality_rules.keep_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored below 0.3; learned from the labels of the documents that are left."""
    ship_package(spark)
    return quality_model.keep_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group linked by 5-word shingles with similarity of at least 0.8."""
    ship_package(spark)
    return jaccard_join.keep_representatives(docs, size=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 ids."""
    ship_package(spark)
    return packing.retrieval_pack(docs, wordbpe.byte_bpe_path(), end_id=1, window=2048)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates),
          ("packing", pack)]

# A trained classifier and BM25 packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


register("pipeline", ORACLE_SQL)(run)
