"""Lineage cuts for iterative jobs.

``Dataset.checkpoint()`` keeps the size statistics of the plan it replaces, so
in a loop of self-joins the estimates compound round after round.  Writing
the intermediate as a Parquet table under the shared checkpoint folder and
reading it back cuts the lineage (an executor loss re-reads the table) and
restarts the statistics from the real file size.  A table that several joins
read by one key is written in buckets of that key (:func:`cut_by`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import scratch_path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"cut/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def cut_by(df: DataFrame, key: str, name: str = "step") -> DataFrame:
    """:func:`cut` into buckets of ``key``: a join on ``key`` then moves its other side only.

    ``df`` must be partitioned by :func:`by_key`, so that a task writes one bucket.
    """
    spark = df.sparkSession
    table = f"feedrank_{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, f"cut/{name}-{uuid.uuid4().hex}")
    df.write.bucketBy(_buckets(df), key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")           # the files stay; the catalog is left as it was
    return out


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled by ``key`` for :func:`cut_by`; what is grouped or joined by ``key`` after it is not shuffled again."""
    return df.repartition(_buckets(df), key)


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
