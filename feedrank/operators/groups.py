"""Per-cluster grouping: samples, profile texts, labels, nested results (AGG3/4/7, JN6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import top_per_group

PROFILE_SEP = "\n---\n"


def samples(entries: DataFrame, cluster: str = "cluster_id", order: str = "src_pos",
            text: str = "text", max_samples: int = 8) -> DataFrame:
    """First ``max_samples`` texts per cluster in input order, noise skipped (AGG4).

    Returns long rows ``(cluster, order, text, sample_rank)``; the window is a
    ``WindowGroupLimit``, so a huge cluster sends at most ``max_samples`` rows
    per partition to the shuffle.
    """
    e = entries.filter(F.col(cluster) != -1)
    return top_per_group(e, [cluster], [F.col(order)], max_samples, rank_col="sample_rank")


def gather_samples(long_samples: DataFrame, cluster: str = "cluster_id", order: str = "src_pos",
                   text: str = "text", id_col: str = "entry_id") -> DataFrame:
    """``(cluster, ids ARRAY, texts ARRAY)`` from bounded sample rows."""
    s = long_samples.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct(order, id_col, text))).alias("s"))
    return s.select(cluster, F.transform("s", lambda x: x[id_col]).alias("ids"),
                    F.transform("s", lambda x: x[text]).alias("texts"))


def profile_text(gathered: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Profile text per cluster: its samples joined by ``\\n---\\n`` (AGG3)."""
    return gathered.select(cluster, F.array_join("texts", PROFILE_SEP).alias("profile_text"))


def attach_labels(clusters: DataFrame, labels: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Left-join labels; missing or failed labels become ``Cluster <id>`` (JN6)."""
    j = clusters.join(labels, cluster, "left")
    return j.withColumn("label", F.coalesce(F.col("label"), F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))))


def nest_results(clusters: DataFrame, ranked: DataFrame, item_cols: list[str],
                 cluster: str = "cluster_id", rank: str = "rank") -> DataFrame:
    """One row per cluster with its ranked items; clusters without items get ``[]`` (AGG7).

    Lists are bounded by the top-k that produced ``ranked``.
    """
    items = ranked.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct(rank, *item_cols))).alias("items"))
    out = clusters.select(cluster).distinct().join(items, cluster, "left")
    empty = F.array().cast(items.schema["items"].dataType)
    return out.withColumn("items", F.coalesce(F.col("items"), empty))
