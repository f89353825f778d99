"""The registered reduction and clustering queries read every vector."""

import numpy as np
import pytest

from feedrank.plans import catalog, recommend
from level_reference import level_labels
from test_condensed_balls import _tree


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(c, 0.5, (55, 60)) for c in (0, 6)])
    folder = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(X)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, X


def test_density_cluster_equals_brute_force_on_all_vectors(spark, table):
    folder, X = table
    got = {r["entry_id"]: r["cluster_id"] for r in catalog.density_cluster(spark, folder).collect()}
    want = level_labels(len(X), _tree(X, catalog.DENSE_SAMPLES), catalog.DENSE_SIZE)
    assert got == dict(enumerate(want)) and len(set(want) - {-1}) >= 2


def test_reductions_and_pipeline_are_given_all_vectors(spark, table, monkeypatch):
    folder, X = table
    assert sorted(r["entry_id"] for r in catalog.reduce_pca(spark, folder).collect()) == list(range(len(X)))
    given = []

    class Stop(Exception):
        pass

    def stop(points, *args, **kwargs):
        given.append(points.count())
        raise Stop

    monkeypatch.setattr(catalog.RD, "reduce_graph", stop)
    monkeypatch.setattr(recommend, "cluster_library", stop)
    for query in (catalog.reduce_graph, catalog.cluster_pipeline):
        with pytest.raises(Stop):
            query(spark, folder)
    assert given == [len(X)] * 2


def test_cluster_pipeline_reduces_by_the_neighbour_graph(spark, table, monkeypatch):
    folder, X = table
    given = {}

    class Stop(Exception):
        pass

    def stop(points, n_components, n_neighbors, seed, **kwargs):
        given.update(kwargs, n=points.count(), dims=n_components, neighbors=n_neighbors)
        raise Stop

    monkeypatch.setattr(catalog.RD, "reduce_graph", stop)
    with pytest.raises(Stop):
        catalog.cluster_pipeline(spark, folder)
    assert (given["n"], given["dims"], given["neighbors"]) == (len(X), catalog.N_COMPONENTS, catalog.N_NEIGHBORS)
