"""Vector aggregation and vector-set maintenance."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import next_id, with_sequence


def mean_vector(df: DataFrame, vec: str = "vector", by: list[str] | None = None,
                out: str = "mean") -> DataFrame:
    """Element-wise mean of an array column, overall or per group.

    Uses ``Summarizer`` (partial + final aggregation), so no vector is ever
    shuffled whole; only one partial state per partition and group moves.
    """
    v = array_to_vector(F.col(vec).cast("array<double>"))
    aggs = [vector_to_array(Summarizer.mean(v)).alias(out), F.count(F.lit(1)).alias("n")]
    if by:
        return df.groupBy(*by).agg(*aggs)
    # a constant group instead of a global aggregate: empty input gives no row
    return df.groupBy(F.lit(0).alias("_all")).agg(*aggs).drop("_all")


def profile_mean(library: DataFrame, vec: str = "vector") -> DataFrame:
    """Global profile vector (AGG1): one row ``(profile_id=0, vector, n)``."""
    return (mean_vector(library, vec, out="vector")
            .filter(F.col("n") > 0)
            .select(F.lit(0).cast("bigint").alias("profile_id"), "vector", "n"))


def centroids(assigned: DataFrame, vec: str = "vector", cluster: str = "cluster_id") -> DataFrame:
    """Per-cluster centroid in the original space, noise (-1) skipped (AGG2)."""
    return (mean_vector(assigned.filter(F.col(cluster) != -1), vec, by=[cluster], out="centroid")
            .select(F.col(cluster).cast("int").alias("cluster_id"), "centroid", "n"))


def cluster_count(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Number of clusters without noise, plus noise and total counts (AGG5)."""
    c = F.col(cluster)
    return assigned.agg(
        F.count_distinct(F.when(c != -1, c)).alias("n_clusters"),
        F.count_if(c == -1).alias("n_noise"),
        F.count(F.lit(1)).alias("n_entries"))


def check_dim(df: DataFrame, dim: int, vec: str = "vector") -> DataFrame:
    """Fail the job on a vector of the wrong dimension (FLT9)."""
    bad = F.size(F.col(vec)) != dim
    return df.withColumn(vec, F.when(bad, F.raise_error(
        F.concat(F.lit(f"vector dimension must be {dim}, got "), F.size(F.col(vec)).cast("string"))
    )).otherwise(F.col(vec)))


def zip_pairs(df: DataFrame, ids: str, vecs: str, id_out: str = "cluster_id",
              vec_out: str = "centroid") -> DataFrame:
    """Rebuild ``(id, vector)`` rows from parallel arrays (SRC7)."""
    z = df.select(F.inline(F.arrays_zip(F.col(ids).alias("i"), F.col(vecs).alias("v"))))
    return z.select(F.col("i").alias(id_out), F.col("v").alias(vec_out))


def pack_parallel(df: DataFrame, id_col: str, vec_col: str, chunk: int = 256) -> DataFrame:
    """Store ``(id, vector)`` rows as parallel arrays in chunks of at most ``chunk``
    ids (the legacy cache layout).  Every group is bounded by ``chunk``."""
    g = F.floor(F.col(id_col) / chunk).alias("chunk")
    rows = df.groupBy(g).agg(F.array_sort(F.collect_list(F.struct(id_col, vec_col))).alias("s"))
    return rows.select("chunk",
                       F.transform("s", lambda x: x[id_col]).alias("ids"),
                       F.transform("s", lambda x: x[vec_col]).alias("vectors"))


def append_vectors(base: DataFrame, new: DataFrame, dim: int, id_col: str = "set_id",
                   order: str = "src_id", vec: str = "vector") -> DataFrame:
    """Append vectors to a set with ids continuing after the existing ones (SET1).

    ``base`` carries ``id_col``; ``new`` is numbered in ``order`` starting at
    ``max(id) + 1`` (0 for an empty set).  Dimensions are checked first.
    """
    start = next_id(base, id_col)
    added = with_sequence(check_dim(new, dim, vec), order, out=id_col, start=start)
    return check_dim(base, dim, vec).unionByName(added, allowMissingColumns=True)
