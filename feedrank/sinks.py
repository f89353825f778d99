"""Result sinks: nested JSON per cluster, flat ranked JSON, report rows, dated outputs (SNK1-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import file_date
from .functions.ids import ABS_LINK_BASE


def report_lines(labels: DataFrame, ranked: DataFrame) -> DataFrame:
    """Report rows (SNK3): per cluster a heading, one list line per paper, a closing line.

    ``labels``: ``(cluster_id, label)``; ``ranked``: ``(cluster_id, rank,
    paper_id, title, authors ARRAY, category, score)``.  Returns
    ``(cluster_id, line_no, line)``; order a cluster's lines by ``line_no``.
    """
    score = F.format_string("%.3f", F.round("score", 3))
    item = F.concat(F.lit('<li><a href="'), F.lit(ABS_LINK_BASE), F.col("paper_id").cast("string"),
                    F.lit('" target="_blank">'), F.col("title"), F.lit("</a><br><small><i>"),
                    F.coalesce(F.array_join("authors", ", "), F.lit("")), F.lit("</i> ["),
                    F.coalesce(F.col("category"), F.lit("")), F.lit("]</small> – score "), score, F.lit("</li>"))
    items = ranked.select("cluster_id", F.col("rank").cast("int").alias("line_no"), item.alias("line"))
    head = labels.select("cluster_id", F.lit(0).alias("line_no"),
                         F.concat(F.lit("<h2>"), F.col("label"), F.lit("</h2><ol>")).alias("line"))
    last = (labels.select("cluster_id").join(items.groupBy("cluster_id").agg(F.max("line_no").alias("m")),
                                             "cluster_id", "left")
            .select("cluster_id", (F.coalesce(F.col("m"), F.lit(0)) + 1).cast("int").alias("line_no"),
                    F.lit("</ol>").alias("line")))
    return head.unionByName(items).unionByName(last)


def write_nested_json(nested: DataFrame, path: str, run_date=None, mode: str = "overwrite") -> None:
    """One JSON object per cluster, ``{"cluster_id", "label", "items": [...]}``,
    partitioned by the run date (``YYYYMMDD``); the overwrite replaces only
    that date's partition (SNK1, SNK4)."""
    out = nested.withColumn("run_date", file_date(run_date))
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").json(path))


def _write_in_order(rows: DataFrame, order: list[str], path: str, run_date, kind: str, mode: str) -> None:
    """Write one run date's folder as numbered parts that, put one after the other, are in ``order``.

    The sort cuts the rows into ranges, so no task holds them all; the order should be total.
    """
    day = rows.sparkSession.range(1).select(file_date(run_date).alias("d")).first()["d"]
    rows = rows.orderBy(*order)
    rows = rows.select("line") if kind == "text" else rows
    rows.write.mode(mode).format(kind).save(f"{path.rstrip('/')}/run_date={day}")


def write_ranked_json(ranked: DataFrame, path: str, run_date=None, mode: str = "overwrite") -> None:
    """Flat ranked list (SNK2), ordered by rank (then id) over all parts; other run dates stay."""
    _write_in_order(ranked, ["rank", *[c for c in ("paper_id",) if c in ranked.columns]], path, run_date, "json", mode)


def write_report(lines: DataFrame, path: str, run_date=None, mode: str = "overwrite") -> None:
    """Report lines as text, one folder per run date, in cluster and line order over all parts."""
    _write_in_order(lines, ["cluster_id", "line_no", "line"], path, run_date, "text", mode)


def read_in_order(spark: SparkSession, folder: str, kind: str, schema: str | None = None) -> DataFrame:
    """Rows of a folder written in order, with their place ``(_part, _block, _row)``: sort by it to get the order back."""
    source = spark.read.schema(schema) if schema else spark.read
    meta = F.col("_metadata")
    return source.format(kind).load(folder).select(
        "*", F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1).cast("long").alias("_part"),
        meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_row"))
