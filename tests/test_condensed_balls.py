"""Exact condensed tree at any number of weights, and vector joins that skip far blocks."""

import numpy as np
import pytest

from feedrank.operators import balls, condensed, density, knn
from hdbscan_reference import core_distances, prim_mst
from level_reference import level_labels


def _tree(X, ms):
    core, D = core_distances(X, ms)
    M = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(M, np.inf)
    return [(min(a, b), max(a, b), w) for a, b, w in prim_mst(M)]


def _labels(spark, n, edges, least, **kw):
    e = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    return [r["cluster_id"] for r in condensed.label_points(spark.range(n), e, least, **kw).orderBy("id").collect()]


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(c, 0.5 + 0.3 * i, (190, 3)) for i, c in enumerate((0, 4, 9, 14))] + [rng.uniform(-5, 20, (60, 3))])
    return X


@pytest.mark.parametrize("band_edges", [10 ** 6, 150])
def test_more_than_600_weights_equal_brute_force(spark, blobs, band_edges):
    edges = _tree(blobs, 4)
    assert len({w for _, _, w in edges}) > 600
    want = level_labels(len(blobs), edges, 20)
    assert len(set(want)) >= 4                                 # noise and at least three clusters
    assert _labels(spark, len(blobs), edges, 20, band_edges=band_edges) == want


def test_equal_weights_and_flat_bands(spark):
    for seed, least, band in ((2, 4, 25), (3, 6, 20)):
        rng = np.random.default_rng(seed)
        n = 120
        edges = [(int(rng.integers(max(0, v - 9), v)), v, float(rng.choice([0.0, 1.0, 1.0, 2.0, 3.0, 5.0]))) for v in range(1, n)]
        edges = [e for e in edges if e[1] != 90]                # two trees, one point without edges
        assert _labels(spark, n, edges, least, band_edges=band) == level_labels(n, edges, least)


def test_long_chain_of_splits(spark):
    """A cluster that sheds a small cluster at every weight: as many depths as clusters."""
    edges, n, last = [], 0, None
    for k in range(25):
        edges += [(n + i, n + i + 1, 0.01 + 1e-4 * i) for i in range(3)]
        if last is not None:
            edges.append((last, n, 1.0 + k))
        last, n = n, n + 4
    assert _labels(spark, n, edges, 4, band_edges=20) == level_labels(n, edges, 4)


def test_no_edges(spark):
    assert _labels(spark, 3, [], 2) == [-1, -1, -1]


@pytest.fixture(scope="module")
def islands(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(rng.uniform(-30, 30, 8), 0.6, (120, 8)) for _ in range(8)])
    X = np.vstack([X, X[:40], np.zeros((60, 8))])               # repeated vectors
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id bigint, vector array<double>")
    return X, df.repartition(4).cache()


def test_ball_knn_equals_the_full_join_and_scores_less(spark, islands):
    X, df = islands
    counts = {}
    got = balls.ball_knn(df, df, 7, block_rows=32, counts=counts).orderBy("query_id", "rank").collect()
    assert got == knn.knn_join(df, df, 7).orderBy("query_id", "rank").collect()
    assert counts["all"] == len(X) ** 2 and counts["scored"] < 0.25 * counts["all"]


def test_ball_knn_of_two_tables_with_string_ids_and_small_sides(spark, islands):
    _, df = islands
    left = df.filter("id < 50").selectExpr("concat('q', id) as q", "vector as x")
    odd = left.unionByName(spark.createDataFrame([(None, [0.0] * 8), ("none", None)], left.schema))
    for right in (df.filter("id % 3 = 0"), df.filter("id < 4")):
        got = balls.ball_knn(odd, right, 5, "q", "id", "x", "vector", block_rows=16).orderBy("query_id", "rank").collect()
        assert got == knn.knn_join(left, right, 5, "q", "id", "x", "vector").orderBy("query_id", "rank").collect()
    assert balls.ball_knn(left, df.limit(0), 5, "q", "id", "x", "vector").count() == 0


def test_spanning_tree_over_near_blocks(spark, islands, monkeypatch):
    X, df = islands
    monkeypatch.setattr(density, "BLOCK_ROWS", 32)
    monkeypatch.setattr(balls, "BLOCK_ROWS", 32)
    monkeypatch.setattr(balls.ball_blocks, "__defaults__", (32,))
    near = density.nearest(df, 6)
    core = density.core_distances(df, 6)
    want = sum(w for _, _, w in _tree(X, 6))
    for known in (near, None):
        counts = {}
        mst = density.mutual_reachability_mst(df, core, near=known, counts=counts).collect()
        assert len(mst) == len(X) - 1
        assert sum(r["w"] for r in mst) == pytest.approx(want, rel=1e-12)
        if known is not None:
            assert max(counts["scored"]) < 0.5 * len(X) ** 2


def test_known_neighbours_spare_the_first_rounds_their_search(spark):
    """Points whose lightest edges are among their known neighbours are not searched for; the tree is the same."""
    rng = np.random.default_rng(8)
    X = rng.normal(0, 1, (400, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id bigint, vector array<double>").repartition(4).cache()
    near, core = density.neighbours_and_cores(df, 3)
    assert near.count() == (3 + density.SEARCHED) * len(X)
    counts = {}
    mst = density.mutual_reachability_mst(df, core, near=near, counts=counts).collect()
    assert len(mst) == len(X) - 1 and sum(r["w"] for r in mst) == pytest.approx(sum(w for _, _, w in _tree(X, 3)), rel=1e-12)
    assert counts["scored"][0] == 0
