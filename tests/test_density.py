"""Density clustering: brute-force agreement and clustering invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedrank.operators import density
from hdbscan_reference import hdbscan_labels, prim_mst


def _blobs(seed=3, sizes=(60, 50, 45), dim=6, noise=25):
    rng = np.random.default_rng(seed)
    parts = []
    for i, s in enumerate(sizes):
        c = rng.normal(0, 1, dim) * 8
        parts.append(c + rng.normal(0, 0.6, (s, dim)))
    parts.append(rng.uniform(-14, 14, (noise, dim)))
    X = np.vstack(parts)
    perm = rng.permutation(len(X))
    return X[perm]


def _df(spark, X):
    rows = [(int(i), [float(v) for v in x]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


def test_mst_weight_matches_prim(spark):
    X = _blobs(sizes=(30, 25), noise=10)
    df = _df(spark, X)
    core = density.core_distances(df, 5)
    mst = density.mutual_reachability_mst(df, core).collect()
    core_np, D = __import__("hdbscan_reference").core_distances(X, 5)
    M = np.maximum(D, np.maximum(core_np[:, None], core_np[None, :]))
    np.fill_diagonal(M, np.inf)
    ref = prim_mst(M)
    assert len(mst) == len(X) - 1
    assert sum(r["w"] for r in mst) == pytest.approx(sum(e[2] for e in ref), rel=1e-9)


@pytest.mark.parametrize("mcs", [10, 20])
def test_labels_match_brute_force(spark, mcs):
    X = _blobs()
    got = {r["id"]: r["cluster_id"] for r in density.density_cluster(_df(spark, X), mcs).collect()}
    ref = hdbscan_labels(X, mcs)
    assert [got[i] for i in range(len(X))] == ref.tolist()


def test_clusters_respect_min_size_and_order_invariance(spark):
    X = _blobs(seed=5)
    a = {r["id"]: r["cluster_id"] for r in density.density_cluster(_df(spark, X), 15).collect()}
    sizes = np.bincount([c for c in a.values() if c >= 0])
    assert len(sizes) >= 2 and sizes.min() >= 15
    shuffled = _df(spark, X).repartition(3).orderBy(F.rand(7))
    b = {r["id"]: r["cluster_id"] for r in density.density_cluster(shuffled, 15).collect()}
    assert a == b


def test_min_samples_differs_from_min_cluster_size(spark):
    X = _blobs(seed=8, sizes=(40, 35, 30), noise=15)
    got = {r["id"]: r["cluster_id"] for r in density.density_cluster(_df(spark, X), 12, min_samples=4).collect()}
    ref = hdbscan_labels(X, 12, min_samples=4)
    assert [got[i] for i in range(len(X))] == ref.tolist()


def test_large_and_string_ids(spark):
    X = np.random.default_rng(3).normal(size=(30, 3))
    small, big = (spark.createDataFrame([(b + i, [float(v) for v in x]) for i, x in enumerate(X)],
                                        "id bigint, vector array<double>") for b in (0, 2**60))
    trees = []
    for df, b in ((small, 0), (big, 2**60)):
        mst = density.mutual_reachability_mst(df, density.core_distances(df, 3))
        trees.append({(r["u"] - b, r["v"] - b) for r in mst.collect()})
    assert len(trees[0]) == 29 and trees[0] == trees[1]
    named = small.selectExpr("lpad(id, 3, '0') as id", "vector")
    want = {f"{r['id']:03d}": r["cluster_id"] for r in density.density_cluster(small, 5, 3).collect()}
    assert {r["id"]: r["cluster_id"] for r in density.density_cluster(named, 5, 3).collect()} == want
