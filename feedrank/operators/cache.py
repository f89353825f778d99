"""Content-keyed result caches: hit/miss split, upsert, read and write (JN7, SET2, SRC6-9, SNK5-8).

A cache is a Parquet table keyed by content (text hash, model, task, or
``(paper_id, config_hash)``).  Inference runs on misses only; new results are
appended, and an upsert lets a new value win over an old one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def split_cache(requests: DataFrame, cache: DataFrame, keys: list[str],
                valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)``: hits carry the cached columns; a cached row counts
    only when ``valid`` holds (e.g. a label that is present and not failed).
    Of several such rows of one key one is used, so hits are never multiplied."""
    good = (cache.filter(valid) if valid is not None else cache).dropDuplicates(keys)
    hits = requests.join(good, keys, "inner")
    misses = requests.join(good.select(*keys), keys, "left_anti")
    return hits, misses


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key (SET2)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def read_cache(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
               skip_corrupt: bool = False) -> DataFrame:
    """Read a cache; a missing one is an empty table (SRC8).

    JSON caches drop malformed records instead of failing the job.  Unreadable
    Parquet files fail the job, unless ``skip_corrupt`` asks to leave them out
    (their keys are then misses).  Any other error is raised.
    """
    reader = spark.read.schema(schema)
    try:
        if fmt == "json":
            return reader.option("mode", "DROPMALFORMED").json(path)
        return reader.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_cache(df: DataFrame, path: str, partition_by: list[str] | None = None,
                only_nonempty: str | None = None) -> None:
    """Append new cache rows; with ``only_nonempty`` rows whose column is NULL
    or '' are not written (SNK8)."""
    out = df
    if only_nonempty:
        out = out.filter(F.col(only_nonempty).isNotNull() & (F.col(only_nonempty) != ""))
    w = out.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def content_key(text: str = "text", model: str = "model", task: str = "task") -> Column:
    """Content hash used as the cache key of an inference input."""
    return F.sha2(F.concat_ws("\u0001", F.col(model), F.col(task), F.col(text)), 256)
