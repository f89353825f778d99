"""Batch inference retries and rejects; cached inference runs misses only."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from feedrank.operators import infer
from feedrank.operators.cache import read_cache, split_cache, upsert
from feedrank.session import scratch_path

OUT = StructType([StructField("score", DoubleType())])


def test_retry_then_success(spark):
    import tempfile
    folder = tempfile.mkdtemp(prefix="feedrank-flaky-")
    df = spark.range(10).select(F.col("id"), F.col("id").cast("string").alias("text"))

    def flaky(pdf):
        import os
        marker = os.path.join(folder, f"flaky-{pdf['text'].iloc[0]}")
        if not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("quota")
        return pd.DataFrame({"score": pdf["text"].astype(float) / 10})

    out = infer.batch_infer(df, flaky, ["id"], ["text"], OUT, batch_size=4, retries=3, sleep=lambda s: None)
    rows = out.collect()
    assert all(r["infer_error"] is None for r in rows)
    assert sorted(r["score"] for r in rows) == [i / 10 for i in range(10)]


def test_only_the_rows_of_a_call_become_python_objects(spark, monkeypatch):
    # 4,000 texts of 5,000 characters come in one batch; as Python objects they would take 20 MB
    df = spark.range(4000, numPartitions=1).select("id", F.repeat(F.lit("ab"), 2500).alias("text"), F.repeat(F.lit("x"), 100).alias("other"))

    def live(pdf):
        import gc
        kept = max((len(x) for x in gc.get_objects() if isinstance(x, pd.DataFrame)), default=0)
        return pd.DataFrame({"score": [float(kept)] * len(pdf)})

    got = infer.batch_infer(df, live, ["id"], ["text"], OUT).collect()
    assert len(got) == 4000 and max(r["score"] for r in got) <= 32


def test_exhausted_budget_marks_rows(spark):
    df = spark.range(5).select("id", F.lit("x").alias("text"))

    def broken(pdf):
        raise ValueError("bad")

    out = infer.batch_infer(df, broken, ["id"], ["text"], OUT, batch_size=2, retries=2, sleep=lambda s: None)
    rows = out.collect()
    assert len(rows) == 5 and all(r["score"] is None and "bad" in r["infer_error"] for r in rows)


def test_non_retryable_stops_early(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.range(1).select("id", F.lit("x").alias("text"))

    def fn(pdf):
        calls.add(1)
        raise KeyError("permanent")

    infer.batch_infer(df, fn, ["id"], ["text"], OUT, retries=5, retryable=lambda e: False,
                      sleep=lambda s: None).collect()
    assert calls.value == 1


def test_cache_second_run_does_no_inference(spark):
    path = scratch_path(spark, "test-cache-" + str(id(spark)) + "-" + __import__("uuid").uuid4().hex)
    req = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).cast("string").alias("text"))
    calls = spark.sparkContext.accumulator(0)

    def run(misses):
        def fn(pdf):
            calls.add(len(pdf))
            return pd.DataFrame({"score": pdf["text"].astype(float)})
        return infer.batch_infer(misses, fn, ["k"], ["text"], OUT, batch_size=8)

    schema = "k bigint, score double"
    first = infer.cached_inference(req, read_cache(spark, path, spark.createDataFrame([], schema).schema),
                                   ["k"], run, cache_path=path)
    assert first.count() == 20 and calls.value == 20
    cache = spark.read.parquet(path)
    second = infer.cached_inference(req, cache, ["k"], run, cache_path=None)
    assert second.count() == 20 and calls.value == 20


def test_split_and_upsert(spark):
    req = spark.range(6).withColumnRenamed("id", "k")
    cache = spark.createDataFrame([(0, "a"), (1, None), (2, "c")], "k bigint, label string")
    hits, misses = split_cache(req, cache, ["k"], valid=F.col("label").isNotNull())
    assert sorted(r["k"] for r in hits.collect()) == [0, 2]
    assert sorted(r["k"] for r in misses.collect()) == [1, 3, 4, 5]
    new = spark.createDataFrame([(1, "b"), (2, "C")], "k bigint, label string")
    assert sorted((r["k"], r["label"]) for r in upsert(cache, new, ["k"]).collect()) == [(0, "a"), (1, "b"), (2, "C")]


def test_cache_write_skips_empty_and_missing_cache_reads_empty(spark):
    from feedrank.operators.cache import write_cache
    schema = spark.createDataFrame([], "paper_id string, config_hash string, explanation string").schema
    path = scratch_path(spark, "test-expl-" + __import__("uuid").uuid4().hex)
    assert read_cache(spark, path, schema).count() == 0                      # absent cache -> empty
    rows = spark.createDataFrame([("a", "h", "text"), ("b", "h", ""), ("c", "h", None)], schema)
    write_cache(rows, path, only_nonempty="explanation")
    assert [r["paper_id"] for r in read_cache(spark, path, schema).collect()] == ["a"]


def test_pacing_between_batches(spark):
    waited = spark.sparkContext.accumulator(0.0)

    def fn(pdf):
        return pd.DataFrame({"score": [1.0] * len(pdf)})

    df = spark.range(7).coalesce(1).select("id", F.lit("x").alias("text"))
    out = infer.batch_infer(df, fn, ["id"], ["text"], OUT, batch_size=3, pacing=0.05,
                            sleep=lambda s: waited.add(s))
    rows = out.collect()                      # one action: 3 sub-batches -> 2 pauses
    assert len(rows) == 7 and all(r["infer_error"] is None for r in rows)
    assert abs(waited.value - 0.1) < 1e-9


def test_repeated_requests_and_failures_keep_every_request(spark):
    path = scratch_path(spark, "test-cache-dup-" + __import__("uuid").uuid4().hex)
    req = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("bad", "x")], "k string, text string")
    empty = spark.createDataFrame([], "k string, score double")

    def run(misses):
        return infer.batch_infer(misses, lambda p: pd.DataFrame({"score": p["text"].astype(float)}), ["k"], ["text"],
                                 OUT, batch_size=1, retries=1)

    first = infer.cached_inference(req, empty, ["k"], run, cache_path=path).collect()
    assert sorted((r["k"], r["score"]) for r in first if r["k"] != "bad") == [("a", 1.0), ("a", 1.0), ("b", 2.0)]
    assert [r["score"] for r in first if r["infer_error"]] == [None] and len(first) == 4
    cache = spark.read.parquet(path)
    assert cache.count() == 2
    again = infer.cached_inference(req, cache.unionByName(cache), ["k"], run)
    assert again.count() == 4
