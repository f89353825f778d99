"""Committed result stores, content-keyed caches and a run with a user's models."""

import json
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedrank.operators import store as S
from feedrank.plans.models import Models
from feedrank.plans.recommend import run_library
from feedrank.session import scratch_path


def _store(spark, name="store", schema="key string, value double"):
    return S.ResultStore(spark, scratch_path(spark, f"{name}/{uuid.uuid4().hex}"), schema, ["key"])


def _rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value double")


def test_a_write_without_its_manifest_row_is_not_read(spark):
    s = _store(spark)
    assert s.read().count() == 0
    s.append(_rows(spark, ("a", 1.0)))
    s.write(_rows(spark, ("b", 2.0)))                      # killed before its commit
    assert [tuple(r) for r in s.read().collect()] == [("a", 1.0)]


def test_two_writers_of_one_key_and_compaction(spark):
    s = _store(spark)
    for value in (3.0, 1.0, 2.0):
        s.append(_rows(spark, ("a", value), ("a", value), (f"k{value}", value)))
    before = sorted(map(tuple, s.read().collect()))
    assert len(before) == 4                                # one row a key, the same in every reading
    late = s.write(_rows(spark, ("z", 9.0)))
    s.compact()
    assert len(s.attempts()) == 1 and sorted(map(tuple, s.read().collect())) == before
    s.commit(late)                                         # a writer that was under way stays
    assert sorted(map(tuple, s.read().collect())) == sorted([*before, ("z", 9.0)])


def test_failed_rows_are_returned_and_asked_again(spark):
    s = _store(spark)
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "key string, row int")
    s.append(_rows(spark, ("c", 7.0)))
    calls = []

    def infer(rows):
        calls.append(sorted(r["key"] for r in rows.collect()))
        return rows.select("key", F.when(F.col("key") == "a", 1.0).alias("value"), F.when(F.col("key") == "b", "quota").alias("infer_error"))

    got = {r["row"]: (r["value"], r["origin"], r["infer_error"]) for r in S.cached_results(asked, s, infer).collect()}
    assert got == {1: (1.0, "model", None), 2: (1.0, "model", None), 3: (None, "model", "quota"), 4: (None, None, None), 5: (7.0, "cache", None)}
    assert [r["origin"] for r in S.cached_results(asked.filter("key = 'a'"), s, infer).collect()] == ["cache", "cache"]
    S.cached_results(asked, s, infer).collect()
    assert calls == [["a", "b"], ["b"]]


def test_fingerprint_counts_rows_and_ignores_their_order(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (2, [3.0])], "id long, `v.x` array<double>")
    f = S.fingerprint(df)
    assert f == S.fingerprint(df.orderBy(F.desc("id")).repartition(3))
    assert len({f, S.fingerprint(df.dropDuplicates()), S.fingerprint(df, "other"), S.fingerprint(df.limit(0)),
                S.fingerprint(df.withColumn("id", F.col("id") + 1))}) == 5


def test_clusters_are_computed_once_for_the_same_vectors(spark):
    path = scratch_path(spark, f"clusters/{uuid.uuid4().hex}")
    lib = spark.createDataFrame([(f"e{i}", [float(i), 0.5]) for i in range(6)], "entry_id string, vector array<double>")
    runs = []

    def compute(rows):
        runs.append(rows.count())
        return rows.select("entry_id", F.lit(1).alias("cluster_id")), spark.createDataFrame([(1, [2.5, 0.5])], "cluster_id int, centroid array<double>")

    first = S.cached_clusters(lib, path, compute, "a")
    again = S.cached_clusters(lib.repartition(4), path, compute, "a")
    assert (first[2], again[2], runs) == (False, True, [6])
    assert sorted(map(tuple, first[0].collect())) == sorted(map(tuple, again[0].collect()))
    for other, config in ((lib.filter("entry_id <> 'e3'"), "a"), (lib.unionByName(lib.limit(1)), "a"), (lib, "b")):
        assert S.cached_clusters(other, path, compute, config)[2] is False


def test_a_killed_clustering_is_computed_again(spark):
    path = scratch_path(spark, f"clusters/{uuid.uuid4().hex}")
    lib = spark.createDataFrame([("e", [1.0])], "entry_id string, vector array<double>")

    def broken(rows):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        S.cached_clusters(lib, path, broken)
    ok = lambda rows: (rows.select("entry_id", F.lit(-1).alias("cluster_id")),
                       spark.createDataFrame([], "cluster_id int, centroid array<double>"))
    assert S.cached_clusters(lib, path, ok)[2] is False and S.cached_clusters(lib, path, broken)[2] is True


TOPICS = ("stars and planets", "bread and butter")


def _texts(spark, n, prefix):
    return spark.createDataFrame([(f"{prefix}{i}", i, f"{TOPICS[i % 2]} number {i}") for i in range(n)], "id string, pos int, text string")


def test_run_with_models_asks_for_nothing_twice(spark):
    asked = {k: spark.sparkContext.accumulator(0) for k in ("embed", "label", "explain", "score")}

    def embed(pdf):
        asked["embed"].add(len(pdf))
        return pd.DataFrame({"vector": [[float("stars" in t), float("bread" in t), len(t) / 1000] for t in pdf["text"]]})

    def label(pdf):
        asked["label"].add(len(pdf))
        return pd.DataFrame({"label": ["Sky" if "stars" in s else "" for s in pdf["samples"]]})       # the other one fails

    def explain(pdf):
        asked["explain"].add(len(pdf))
        return pd.DataFrame({"explanation": ["About " + t for t in pdf["text"]]})

    def score(pdf):
        asked["score"].add(len(pdf))
        return pd.DataFrame({"score": [float("nan") if "number 1" == t[-8:] else len(t) / 100 for t in pdf["text"]]})

    base = scratch_path(spark, f"run-models/{uuid.uuid4().hex}")
    lib = _texts(spark, 40, "e").select(F.col("id").alias("entry_id"), F.col("pos").alias("src_pos"), "text")
    papers = _texts(spark, 12, "2305.").select(F.col("id").alias("paper_id"), "text", F.col("text").alias("title"),
                                              F.array(F.lit("A")).alias("authors"), F.lit("cs.LG").alias("category"))
    models = Models(embed, score, label, explain, retry={"embed": {"pacing": 0.0}})
    results, counts = [], []
    for name in ("one", "two"):
        ranked = run_library(lib, papers, f"{base}/{name}", "2024-01-02", 5, 2, cluster=True, use_rerank=True, min_cluster_size=8,
                             models=models, cache_dir=f"{base}/cache", cluster_method="none")
        results.append(sorted(map(tuple, ranked.collect())))
        counts.append({k: v.value for k, v in asked.items()})
    assert results[0] == results[1] and len(results[0]) == 10
    assert counts[0]["embed"] == 52 and counts[0]["explain"] == 10 and counts[0]["label"] == 2
    # the second run embeds and explains nothing and asks for the failed label only
    assert [counts[1][k] - counts[0][k] for k in ("embed", "explain", "label")] == [0, 0, 1]
    assert {r[3] for r in results[0] if r[2] == "2305.1"} <= {0.0}
    folder = f"{base}/two/json/run_date=20240102".replace("file:", "")
    out = [json.loads(x) for p in os.listdir(folder) if p.endswith(".json") for x in open(f"{folder}/{p}")]
    assert {o["label"] for o in out} == {"Sky", "Cluster 1"} or {o["label"] for o in out} == {"Sky", "Cluster 0"}
    assert all(i["explanation"].startswith("About ") for o in out for i in o["items"])


def test_models_need_a_cache_folder(spark):
    lib = _texts(spark, 2, "e").select(F.col("id").alias("entry_id"), F.col("pos").alias("src_pos"), "text")
    with pytest.raises(ValueError):
        run_library(lib, lib, "unused", None, models=Models(embed=lambda p: p))
