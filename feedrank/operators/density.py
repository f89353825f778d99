"""Hierarchical density clustering (CL2, HDBSCAN semantics) and the clustering step (CL3).

1. Core distance of a point: distance to its ``min_samples``-th nearest point,
   the point itself counted first (exact k-NN over near blocks, ``balls.ball_knn``).
2. Mutual reachability ``mrd(a, b) = max(core_a, core_b, d(a, b))``; its
   minimum spanning tree is built exactly by Borůvka rounds: every component
   keeps its lightest edge to another one under the total order ``(w, lo, hi)``,
   and components merge along them.
3. Condensed tree, excess of mass and labels: exact at any size (``condensed``);
   edges of equal weight are removed together.  Labels are numbered by each
   cluster's smallest member id; noise is -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .balls import BLOCK_ROWS, ball_blocks, ball_knn, lightest_edges, pivots
from .condensed import BAND_EDGES, label_points
from .joins import is_bounded
from .knn import knn_join
from .lineage import cut

SEARCHED = 16                   # neighbours beyond the core's that are known before the tree is searched for
FEW_BLOCKS = 32                 # below so many blocks every pair is scored


def nearest(points: DataFrame, min_samples: int, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """Every point's ``min_samples`` nearest points, itself among them.

    Both joins give the same rows; a table of few blocks is not worth bounds.
    """
    join = knn_join if is_bounded(points, FEW_BLOCKS * BLOCK_ROWS) else ball_knn
    return join(points, points, min_samples, id_col, id_col, vec, vec)


def core_distances(points: DataFrame, min_samples: int, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """``(id, core)``: Euclidean distance to the ``min_samples``-th nearest point (self first)."""
    nn = nearest(points, min_samples, id_col, vec)
    return nn.groupBy(F.col("query_id").alias(id_col)).agg(F.sqrt(F.max("distance")).alias("core"))


def neighbours_and_cores(points: DataFrame, min_samples: int, id_col: str = "id", vec: str = "vector") -> tuple[DataFrame, DataFrame]:
    """``(near, core)``: some more than ``min_samples`` nearest points of every point, written, and core distances from them."""
    near = cut(nearest(points, min_samples + SEARCHED, id_col, vec), "density-near")
    core = near.filter(F.col("rank") <= min_samples).groupBy(F.col("query_id").alias(id_col)).agg(F.sqrt(F.max("distance")).alias("core"))
    return near, core


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges ``(query_id, neighbor_id, w)`` of both their ends."""
    return edges.unionByName(edges.select(F.col("query_id").alias("neighbor_id"), F.col("neighbor_id").alias("query_id"), "w")).distinct()


def _jump_to_roots(parent: DataFrame) -> DataFrame:
    """Follow ``parent`` pointers to the roots by doubling: ``(node, parent)``."""
    cur = parent
    while True:         # each turn follows 8 times as many pointers
        for _ in range(3):
            p = cur.select(F.col("node").alias("parent"), F.col("parent").alias("pp"))
            cur = cur.join(p, "parent", "left").select("node", F.coalesce(F.col("pp"), F.col("parent")).alias("parent"))
        cur = cut(cur, "mst-jump")
        root = cur.filter("node = parent").select("node")
        if cur.join(root.withColumnRenamed("node", "parent"), "parent", "left_anti").limit(1).count() == 0:
            return cur


def mutual_reachability_mst(points: DataFrame, core: DataFrame, id_col: str = "id", vec: str = "vector",
                            max_rounds: int = 64, near: DataFrame | None = None, counts: dict | None = None) -> DataFrame:
    """Exact minimum spanning forest ``(u, v, w)`` of the mutual reachability graph.

    Borůvka: each round every component takes its lightest outgoing edge
    under the total order ``(w, lo, hi)``.  The chosen edges point each
    component to another; every resulting tree has exactly one mutual pair,
    whose smaller id becomes the root, and pointer jumping merges the rest.

    ``near (query_id, neighbor_id, distance)`` are the nearest neighbours of every
    point, as many as there are; with the lightest edges that points found in
    earlier rounds they bound what a component still has to look for, so far
    blocks are not scored (``balls.lightest_edges``).  ``counts`` receives the
    pairs scored a round.

    A point looks for edges only if it can hold its component's lightest beside
    the known ones: an edge to a point that is not among its nearest is as long as
    the farthest of these; no edge of it to another component weighs less than
    the ``low`` of its last search, since components only grow, and an edge that
    was its lightest and still leaves its component is its lightest.
    """
    spark = points.sparkSession
    pts = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).join(
        core.select(F.col(id_col).cast("bigint").alias("id"), "core"), "id")
    pts = cut(pts, "mst-points")
    n_pts = pts.count()
    if n_pts < 2:
        return spark.createDataFrame([], "u bigint, v bigint, w double")
    mid = pivots(pts, "id", "v", -(-n_pts // BLOCK_ROWS))
    blocks = ball_blocks(pts, "id", "v", mid)
    comp = pts.select("id", F.col("id").alias("comp"))
    cores = pts.select("id", "core")
    known = None                    # edges that bound the search: (query_id, neighbor_id, w)
    last = cores.select("id", F.col("core").alias("low"), F.lit(None).cast("bigint").alias("to"))      # no edge is below its ends' cores
    if near is not None:
        of = lambda c, out: cores.select(F.col("id").alias(c), F.col("core").alias(out))
        known = near.filter("query_id <> neighbor_id").select(F.col("query_id").cast("bigint"), F.col("neighbor_id").cast("bigint"), "distance")
        known = cut(_both_ways(known.join(of("query_id", "a"), "query_id").join(of("neighbor_id", "b"), "neighbor_id")
                               .select("query_id", "neighbor_id", F.greatest(F.sqrt("distance"), "a", "b").alias("w"))), "mst-known")
        # neighbours are ordered by distances rounded to 9 digits: one that is not listed may be nearer by that much
        reach = near.groupBy(F.col("query_id").cast("bigint").alias("id")).agg(F.max("distance").alias("d"))
        last = cut(last.join(reach, "id", "left").select("id", F.greatest(
            "low", F.sqrt(F.greatest(F.col("d") - 2e-9, F.lit(0.0)))).alias("low"), "to"), "mst-last")
    n_comp, edges = n_pts, None
    order = F.struct("w", F.least("query_id", "neighbor_id"), F.greatest("query_id", "neighbor_id"))
    lightest = F.min_by(F.struct("query_id", "neighbor_id", "w"), order).alias("e")
    for _ in range(max_rounds):
        if n_comp < 2:
            break
        q = comp.select(F.col("id").alias("query_id"), "comp")
        t = comp.select(F.col("id").alias("neighbor_id"), F.col("comp").alias("target"))
        state = cores.join(comp, "id")
        if known is None:
            state = state.withColumn("far", F.lit(float("inf")))
        else:       # a known edge that leaves its component bounds it
            known = cut(known.join(q, "query_id").join(t, "neighbor_id").filter("comp <> target")
                        .select("query_id", "neighbor_id", "w", "comp"), "mst-known")
            far = known.groupBy("comp").agg(F.min("w").alias("far"))
            state = state.join(far, "comp", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
        leaves = last.join(comp.select(F.col("id").alias("to"), F.col("comp").alias("target")), "to", "left")
        search = cut(state.join(leaves, "id").select("id", "core", "comp", F.when(
            (F.col("low") <= F.col("far")) & ~F.coalesce(F.col("target") != F.col("comp"), F.lit(False)), F.col("far")).otherwise(-1.0).alias("far")), "mst-search")
        if search.filter("far >= 0").limit(1).count():
            found = cut(lightest_edges(blocks, search, counts), "mst-points-best")
            exact = F.when(F.col("w") == F.col("new_low"), F.col("neighbor_id"))
            last = cut(last.join(found.select(F.col("query_id").alias("id"), "neighbor_id", "w", F.col("low").alias("new_low")), "id", "left").select(
                "id", F.coalesce("new_low", "low").alias("low"), F.when(F.col("new_low").isNull(), F.col("to")).otherwise(exact).alias("to")), "mst-last")
            fresh = found.filter(F.col("w") < float("inf")).select("query_id", "neighbor_id", "w").join(q, "query_id")
            both = fresh if known is None else fresh.unionByName(known)
        else:       # every component's lightest edge is known
            both = known
            if counts is not None:
                counts.setdefault("scored", []).append(0)
        per_comp = both.groupBy("comp").agg(lightest).select("comp", "e.*")
        per_comp = cut(per_comp.join(t, "neighbor_id"), "mst-choice")
        chosen = per_comp.select(F.least("query_id", "neighbor_id").alias("u"),
                                 F.greatest("query_id", "neighbor_id").alias("v"), "w").distinct()
        edges = cut(chosen if edges is None else edges.unionByName(chosen), "mst-edges")
        # component -> target; in a mutual pair the smaller id is the root
        back = per_comp.select(F.col("comp").alias("target"), F.col("target").alias("comp"))
        mutual = per_comp.join(back.withColumn("m", F.lit(True)), ["comp", "target"], "left")
        parent = mutual.select(F.col("comp").alias("node"), F.when(
            F.col("m").isNotNull() & (F.col("comp") < F.col("target")), F.col("comp")).otherwise(
            F.col("target")).alias("parent"))
        roots = _jump_to_roots(parent)
        comp = cut(comp.join(roots.select(F.col("node").alias("comp"), "parent"), "comp")
                   .select("id", F.col("parent").alias("comp")), "mst-comp")
        known = _both_ways(both.select("query_id", "neighbor_id", "w"))
        n_comp = comp.select("comp").distinct().count()
    else:
        raise RuntimeError(f"the spanning tree did not close in {max_rounds} rounds")
    return edges


def density_cluster(points: DataFrame, min_cluster_size: int = 40, min_samples: int | None = None,
                    id_col: str = "id", vec: str = "vector", band_edges: int = BAND_EDGES) -> DataFrame:
    """HDBSCAN-style labels ``(id, cluster_id)``; -1 marks noise.

    Ids that are not integers are numbered in their order first, in a written
    table, so a retried task cannot number them anew.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    if not isinstance(points.schema[id_col].dataType, IntegralType):
        numbered = cut(points.select(id_col, vec).orderBy(id_col).withColumn("_node", F.monotonically_increasing_id()),
                       "density-ids")
        found = density_cluster(numbered, min_cluster_size, min_samples, "_node", vec, band_edges)
        return numbered.join(found, "_node").select(id_col, "cluster_id")
    near, core = neighbours_and_cores(points, min_samples or min_cluster_size, id_col, vec)
    mst = mutual_reachability_mst(points, core, id_col, vec, near=near)
    return label_points(points.select(id_col), mst, min_cluster_size, id_col, band_edges)
