"""Landed binaries, sequence numbering, and stream = batch for the assignment job."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from feedrank.operators import knn, sequence, vectors
from feedrank.session import scratch_path
from feedrank.sources import binary
from feedrank.sources import tables as T
from feedrank.streaming.assign_stream import start_assign_stream
from conftest import SF_CHECK


def test_binary_files_attach_and_extract(spark):
    d = tempfile.mkdtemp(prefix="feedrank-pdf-", dir=os.environ.get("TMPDIR", "/tmp"))
    for name, body in [("2305.15334.pdf", b"full text one"), ("cs_0101001.pdf", b"old style id")]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(body)
    papers = spark.createDataFrame([("2305.15334",), ("cs/0101001",), ("9999.00001",)], "paper_id string")
    joined = binary.attach_files(papers, binary.read_landed(spark, d))
    text = {r["paper_id"]: r["full_text"] for r in binary.extract_text(joined).collect()}
    assert text == {"2305.15334": "full text one", "cs/0101001": "old style id", "9999.00001": None}


def test_sequence_matches_row_number(spark):
    df = spark.range(0, 3000, 7).withColumnRenamed("id", "k").repartition(5)
    got = {r["k"]: r["seq"] for r in sequence.with_sequence(df, "k", start=100, n_ranges=6).collect()}
    assert got == {k: 100 + i for i, k in enumerate(range(0, 3000, 7))}


def test_stream_equals_batch(spark):
    cents = vectors.centroids(T.library_vectors(spark, SF_CHECK))
    corpus = T.corpus_vectors(spark, SF_CHECK).withColumn("published", F.lit("2024-01-02").cast("timestamp"))
    run = scratch_path(spark, f"test-stream/{uuid.uuid4().hex}")
    corpus.repartition(4).write.parquet(f"{run}/landing")
    corpus.limit(30).write.mode("append").parquet(f"{run}/landing")      # re-landed duplicates
    q = start_assign_stream(spark, f"{run}/landing", corpus.schema, cents, f"{run}/sink", f"{run}/ckpt",
                            max_files_per_trigger=2)
    q.awaitTermination()
    got = {(r[0], r[1]) for r in spark.read.parquet(f"{run}/sink").select("paper_id", "cluster_id").collect()}
    batch = knn.assign_nearest(T.corpus_vectors(spark, SF_CHECK), cents)
    want = {(r[0], r[1]) for r in batch.select("paper_id", "cluster_id").collect()}
    assert got == want
    assert spark.read.parquet(f"{run}/sink").count() == len(want)


def test_stream_keeps_late_papers_and_replays(spark):
    from feedrank.streaming.assign_stream import batch_writer
    cents = spark.createDataFrame([(0, [0.0]), (1, [9.0])], "cluster_id int, centroid array<double>")
    run = scratch_path(spark, f"test-late/{uuid.uuid4().hex}")
    schema = "paper_id string, vector array<double>, published timestamp"
    for i, day in enumerate(["2024-01-20", "2024-01-20", "2024-01-05"]):
        spark.createDataFrame([(f"p{i}", [float(i)])], "paper_id string, vector array<double>").withColumn(
            "published", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{run}/landing")
    landed = spark.read.schema(schema).parquet(f"{run}/landing")
    start_assign_stream(spark, f"{run}/landing", landed.schema, cents, f"{run}/sink", f"{run}/ckpt",
                        max_files_per_trigger=1).awaitTermination()
    got = spark.read.parquet(f"{run}/sink")
    assert sorted(r["paper_id"] for r in got.collect()) == ["p0", "p1", "p2"]
    for _ in range(2):                             # a batch that is run again
        batch_writer(cents, f"{run}/again")(landed, 7)
    assert spark.read.parquet(f"{run}/again").count() == 3
