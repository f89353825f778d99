"""End-to-end daily run, sinks, and empty inputs."""

import json
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from feedrank.operators import knn
from feedrank.plans.recommend import run_daily
from feedrank.session import scratch_path
from conftest import SF_CHECK

BIB = "".join(
    f"@article{{e{i},\n  title = {{Entry {i}}},\n  abstract = {{{words}}},\n  author = {{A{i} and B{i}}}\n}}\n"
    for i, words in enumerate(["deep learning vision", "graph neural networks", "language models text",
                               "robot control planning", "vision transformers images"]))


def _feed(spark):
    d = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    e = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    return d.join(e.withColumnRenamed("event_id", "doc_id"), "doc_id").select(
        F.col("doc_id").alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"), F.array(F.col("source")).alias("authors"),
        F.col("ts").alias("published"), F.lit("cs.LG").alias("category"))


def test_daily_run_writes_dated_outputs(spark):
    bib_dir = tempfile.mkdtemp(prefix="feedrank-run-", dir=os.environ.get("TMPDIR", "/tmp"))
    with open(os.path.join(bib_dir, "me.bib"), "w") as f:
        f.write(BIB)
    out = scratch_path(spark, f"test-run/{uuid.uuid4().hex}")
    feed = _feed(spark)
    ranked = run_daily(spark, bib_dir, feed, "2024-01-02", out, topk=5)
    rows = ranked.collect()
    day = feed.filter(F.col("published") < "2024-01-02").count()
    assert len(rows) == min(5, day) and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    j = [json.loads(x) for p in os.listdir(f"{out.replace('file:', '')}/json/run_date=20240102")
         if p.endswith(".json") for x in open(f"{out.replace('file:', '')}/json/run_date=20240102/{p}")]
    assert j and j[0]["cluster_id"] == 0 and len(j[0]["items"]) == len(rows)
    assert j[0]["label"] == "Cluster 0"
    report = spark.read.text(f"{out}/report").collect()
    assert report[0]["value"].startswith("<h2>") or any(r["value"].startswith("<h2>") for r in report)


def _day_of_papers(spark, ids):
    rows = [(i, f"Paper {n}", words, ["A"], "2024-01-01 08:00:00", "cs.LG")
            for n, (i, words) in enumerate(zip(ids, ["graph neural networks", "deep learning vision", "soil chemistry"]))]
    feed = spark.createDataFrame(rows + rows[:1], "paper_id string, title string, abstract string, "
                                 "authors array<string>, published string, category string")
    return feed.withColumn("published", F.col("published").cast("timestamp"))


def test_daily_run_with_feed_ids_and_repeated_keys(spark):
    """Ids as the feed gives them; two entries with one citation key; a paper listed twice."""
    bib_dir = tempfile.mkdtemp(prefix="feedrank-run-", dir=os.environ.get("TMPDIR", "/tmp"))
    with open(os.path.join(bib_dir, "me.bib"), "w") as f:
        f.write("".join(f"@article{{{k},\n  title = {{{t}}}\n}}\n" for k, t in
                        [("same", "Graph neural networks"), ("same", "Graph networks"), ("other", "Neural graph models")]))
    out = scratch_path(spark, f"test-run-ids/{uuid.uuid4().hex}")
    ids = ["2305.15334v1", "2305.15335v2", "cs/0101001v1"]
    ranked = run_daily(spark, bib_dir, _day_of_papers(spark, ids), "2024-01-02", out, topk=5, use_rerank=True)
    rows = sorted(ranked.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == [1, 2, 3] and {r["paper_id"] for r in rows} == set(ids)
    assert rows[0]["paper_id"] == "2305.15334v1"


def test_empty_inputs_give_empty_results(spark):
    empty = spark.createDataFrame([], "id bigint, vector array<double>")
    some = spark.createDataFrame([(1, [0.0, 1.0])], "id bigint, vector array<double>")
    assert knn.knn_join(some, empty, 3).count() == 0
    assert knn.knn_join(empty, some, 3).count() == 0
    out = scratch_path(spark, f"test-run-empty/{uuid.uuid4().hex}")
    ranked = run_daily(spark, "/nonexistent/bib", _feed(spark).limit(0), "2024-01-02", out, topk=5)
    assert ranked.count() == 0
