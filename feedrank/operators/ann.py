"""Approximate nearest-neighbour joins: cell probing (JN2) and random projections (JN3).

Both restrict the exact block scoring of :mod:`.knn` to candidate groups:

* IVF: k-means cells trained on a sample of the index side; every index row
  lives in its nearest cell, every query visits its ``nprobe`` nearest cells.
  With ``nprobe = nlist`` the result equals the exact join.
* LSH: ``BucketedRandomProjectionLSH`` hashes (JVM-side); a query meets the
  index rows that share its bucket in any of the hash tables.

Block pairs are formed by an equi-join on the cell / bucket key, so a very
large cell is a skewed key that AQE's skew-join handling splits.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .joins import is_bounded
from .knn import _prefix, assign_nearest, knn_join, pack_blocks, pair_topk


def train_cells(index: DataFrame, nlist: int, vec: str = "vector", sample_rows: int = 256 * 1024,
                seed: int = 0, max_iter: int = 20) -> DataFrame:
    """Coarse cells ``(cell_id INT, centroid ARRAY<DOUBLE>)`` by k-means on a sample.

    The sample is a Bernoulli sample sized to about ``sample_rows`` rows; the
    centres (``nlist`` rows) are the only data that reaches the driver.
    """
    n = index.count()
    frac = min(1.0, sample_rows / max(n, 1))
    sample = index.sample(False, frac, seed) if frac < 1.0 else index
    feats = sample.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, initMode="k-means||").fit(feats)
    spark = index.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    schema = StructType([StructField("cell_id", IntegerType()), StructField("centroid", ArrayType(DoubleType()))])
    return spark.createDataFrame(rows, schema)


def knn_ivf(queries: DataFrame, index: DataFrame, k: int, nlist: int = 256, nprobe: int = 16,
            query_id: str = "id", index_id: str = "id", vec: str = "vector", cells: DataFrame | None = None,
            block_rows: int = 1024, seed: int = 0) -> DataFrame:
    """Approximate k-NN by cell probing: ``(query_id, neighbor_id, distance, rank)``.

    Too few index rows to train ``nlist`` cells falls back to the exact join,
    as the reference's index does on a training failure.
    """
    if cells is None:
        if is_bounded(index, nlist - 1):
            return knn_join(queries, index, k, query_id, index_id, vec, vec)
        cells = train_cells(index, nlist, vec, seed=seed)
    nprobe = max(1, min(nprobe, nlist))
    cell_of = assign_nearest(index, cells, point_id=index_id, center_id="cell_id", point_vec=vec)
    idx = index.select(index_id, vec).join(cell_of.select(index_id, "cell_id"), index_id)
    probes = knn_join(queries, cells, nprobe, query_id, "cell_id", vec, "centroid")
    q = queries.select(query_id, vec).join(
        probes.select(F.col("query_id").alias(query_id), F.col("neighbor_id").cast("int").alias("cell_id")), query_id)
    lb = _prefix(pack_blocks(q, query_id, vec, block_rows, stripe_col="cell_id"), "l")
    rb = _prefix(pack_blocks(idx, index_id, vec, block_rows, stripe_col="cell_id"), "r")
    return pair_topk(lb.join(rb, "stripe"), k, dedup=nprobe > 1)


def knn_lsh(queries: DataFrame, index: DataFrame, k: int, bucket_length: float = 0.125,
            num_tables: int = 8, query_id: str = "id", index_id: str = "id", vec: str = "vector",
            block_rows: int = 1024, seed: int = 0) -> DataFrame:
    """Approximate k-NN by random-projection buckets, exact re-check inside buckets."""
    from pyspark.ml.functions import vector_to_array

    lsh = BucketedRandomProjectionLSH(inputCol="_f", outputCol="_h", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed)
    fit_on = index.select(array_to_vector(F.col(vec).cast("array<double>")).alias("_f")).limit(1)
    model = lsh.fit(fit_on)   # only the input dimension is learnt; the projections come from the seed

    def keyed(df, id_col):
        h = model.transform(df.select(id_col, vec, array_to_vector(F.col(vec).cast("array<double>")).alias("_f")))
        ex = h.select(id_col, vec, F.posexplode("_h").alias("_t", "_b"))
        bucket = F.element_at(vector_to_array("_b"), 1).cast("bigint")
        return ex.select(id_col, vec, F.hash(F.col("_t"), bucket).alias("bucket"))

    lb = _prefix(pack_blocks(keyed(queries, query_id), query_id, vec, block_rows, stripe_col="bucket"), "l")
    rb = _prefix(pack_blocks(keyed(index, index_id), index_id, vec, block_rows, stripe_col="bucket"), "r")
    return pair_topk(lb.join(rb, "stripe"), k, dedup=True)
