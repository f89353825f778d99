"""Incremental scoring of newly landed papers (STR1).

The daily poll of the reference becomes a file-source stream: papers landed
as Parquet files are read once each, de-duplicated by id, and every
micro-batch is assigned to the nearest cluster centroid with the same batch
operator used offline (so stream and batch results agree).

De-duplication is exact: ids are kept in the state store for good, with no
lateness cut, so a paper dated long before the others is scored like any
other.  The state grows with the distinct ids; ``start_assign_stream`` expects
the session to use a disk-backed state store where they outgrow memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.knn import assign_nearest
from ..operators.lineage import cut


def start_assign_stream(spark: SparkSession, landing: str, schema: StructType, centroids: DataFrame,
                        sink: str, checkpoint: str, available_now: bool = True,
                        max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``centroids``: static ``(cluster_id, centroid)``, written once before the
    stream starts.  The output table at ``sink`` holds ``(paper_id,
    cluster_id, distance)`` under one ``batch_id=`` partition a micro-batch; a
    batch that is run again replaces its own partition.  The checkpoint folder
    must be on shared storage.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    papers = reader.parquet(landing).dropDuplicates(["paper_id"])
    centers = cut(centroids.select("cluster_id", "centroid"), "stream-centroids")
    write_batch = batch_writer(centers, sink)
    w = papers.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def batch_writer(centers: DataFrame, sink: str):
    """The ``foreachBatch`` function: assign a batch and write it as partition ``batch_id``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = assign_nearest(batch.select("paper_id", "vector"), centers)
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return write_batch
