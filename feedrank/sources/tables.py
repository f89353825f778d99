"""Driver tables and the domain views built on them.

Mapping of the domain onto the driver tables (see FIXTURES.md):

* library vectors: ``embeddings`` rows with ``vec_id % 10 = 0``; the corpus
  (feed) vectors are the rest.  ``label`` stands in for a cluster id, with
  label 9 playing noise (-1).  Reduction and clustering read all rows.
* papers: ``documents``; first line = title, rest = abstract (absent when the
  text has no newline); ``doc_id`` = ``vec_id``.
* authors: ``conversations.role`` joined by `` and `` in turn order.
* feed: ``events`` with ``ts`` = published, ``event_type`` = category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body_of, title_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the stand-in mapping.
LIBRARY_MOD = 10
NOISE_LABEL = 9
FEED_CATEGORIES = ("click", "view", "purchase")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cluster_of(label) -> Column:
    lab = F.col(label) if isinstance(label, str) else label
    return F.when(lab == NOISE_LABEL, F.lit(-1)).otherwise(lab).cast("int")


def is_library(vec_id: str = "vec_id") -> Column:
    return F.pmod(F.col(vec_id), F.lit(LIBRARY_MOD)) == 0


def library_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library entries: ``(entry_id, vector, cluster_id, src_pos)``."""
    e = read(spark, sf_dir, "embeddings")
    return e.filter(is_library()).select(
        F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"),
        cluster_of("label").alias("cluster_id"), F.col("vec_id").alias("src_pos"))


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, as library entries to reduce and cluster: ``(entry_id, vector)``."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"))


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed papers' vectors: ``(paper_id, vector)``."""
    e = read(spark, sf_dir, "embeddings")
    return e.filter(~is_library()).select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vector"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper records: ``(paper_id, title, abstract, lang, source, text)``."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("paper_id"), title_of("text").alias("title"),
                    body_of("text").alias("abstract"), "lang", "source", "text")


def raw_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation the raw author field: roles joined by `` and `` by turn."""
    c = read(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["role"]), " and ").alias("author_raw"))
