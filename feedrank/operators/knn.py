"""Exact nearest-neighbour joins (JN1, JN4, SRT2) and per-group top-k (WIN1-3).

Vectors are packed into blocks of at most ``block_rows`` rows inside each
partition.  Block pairs are formed by an equi-join on a stripe key, and each
pair is scored in numpy inside the task; a pair emits at most ``k`` rows per
query, so all-pairs distances never become rows.  A final ``row_number``
window (planned as a partial + final ``WindowGroupLimit``) keeps the k best
per query.

Placement: a side whose row count is proven under ``broadcast_rows`` (by
default the rows that fit ``BROADCAST_BYTES`` at the vectors' dimension) is
broadcast as blocks and the other side streams without a shuffle.  When both
sides are large, the larger side is hash-striped once and the smaller side's
blocks are replicated to every stripe.

Distances are squared L2 in double precision, summed left to right over the
dimensions, so they equal the Catalyst expression ``functions.vectors.l2sq``.
Ties are broken by ``round(distance, 9)`` and then the neighbour id.

Ids keep the caller's type (integers or strings) through blocks and pairs.
Rows without an id or a vector take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import DEFAULT_BROADCAST_ROWS, is_bounded


def block_schema(id_type: str) -> str:
    return f"stripe int, n int, dim int, ids array<{id_type}>, mat binary"


# Packed vectors may be broadcast up to this many bytes (rows * dim * 8).
BROADCAST_BYTES = 128 * 1024 * 1024


def broadcast_row_bound(df: DataFrame, vec: str, budget: int = BROADCAST_BYTES,
                        cap: int = DEFAULT_BROADCAST_ROWS) -> int:
    """Rows of ``vec`` that fit the broadcast byte budget (one-row probe for the dimension)."""
    row = df.select(F.size(F.col(vec)).alias("d")).filter(F.col("d") > 0).limit(1).first()
    dim = row["d"] if row else 1
    return max(1, min(cap, budget // (8 * dim + 16)))


# ----------------------------------------------------------------- packing
class _Block:
    def __init__(self, block_rows: int):
        self.block_rows = block_rows
        self.stripe = None
        self.ids: list[np.ndarray] = []
        self.mats: list[np.ndarray] = []
        self.n = 0

    def flush(self):
        if self.n == 0:
            return None
        ids = np.concatenate(self.ids)
        mat = np.ascontiguousarray(np.concatenate(self.mats), dtype=np.float64)
        out = pd.DataFrame({"stripe": [int(self.stripe)], "n": [int(self.n)], "dim": [int(mat.shape[1])],
                            "ids": [ids], "mat": [mat.tobytes()]})
        self.ids, self.mats, self.n = [], [], 0
        return out


def _stack(vectors: pd.Series) -> np.ndarray:
    arr = vectors.to_numpy()
    lens = {len(v) for v in arr}
    if len(lens) > 1:
        raise ValueError(f"vectors of different dimensions in one partition: {sorted(lens)}")
    return np.stack(arr).astype(np.float64, copy=False)


def _packer(block_rows: int):
    def pack(batches):
        blk = _Block(block_rows)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            st = pdf["_stripe"].to_numpy()
            ids = pdf["_id"].to_numpy()
            mat = _stack(pdf["_v"])
            cuts = np.flatnonzero(np.diff(st)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(st)]):
                if blk.stripe is not None and st[a] != blk.stripe:
                    out = blk.flush()
                    if out is not None:
                        yield out
                blk.stripe = st[a]
                pos = a
                while pos < b:
                    take = min(b - pos, block_rows - blk.n)
                    blk.ids.append(ids[pos:pos + take])
                    blk.mats.append(mat[pos:pos + take])
                    blk.n += take
                    pos += take
                    if blk.n == block_rows:
                        yield blk.flush()
        out = blk.flush()
        if out is not None:
            yield out
    return pack


def pack_blocks(df: DataFrame, id_col: str, vec_col: str, block_rows: int = 1024,
                stripes: int | None = None, stripe_col: str | None = None) -> DataFrame:
    """Pack ``(id, vector)`` rows into blocks inside each partition.

    With ``stripes`` each row's stripe is a hash of its id; with ``stripe_col``
    it is that column (a cell or bucket id).  Block contents may differ
    between task attempts while every row's stripe does not.
    """
    if stripe_col:
        stripe = F.col(stripe_col)
    else:
        stripe = F.pmod(F.xxhash64(id_col), F.lit(stripes)) if stripes else F.lit(0)
    rows = (df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"), stripe.cast("int").alias("_stripe"))
            .filter(F.col("_id").isNotNull() & F.col("_v").isNotNull())
            .sortWithinPartitions("_stripe", "_id"))
    return rows.mapInPandas(_packer(block_rows), block_schema(rows.schema["_id"].dataType.simpleString()))


# ----------------------------------------------------------------- scoring
def sq_distances(Q: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Squared L2 between all rows of Q and C, summed over dimensions in order."""
    D = np.zeros((Q.shape[0], C.shape[0]), dtype=np.float64)
    for j in range(Q.shape[1]):
        diff = Q[:, j][:, None] - C[:, j][None, :]
        D += diff * diff
    return D


def topk_mask(D: np.ndarray, col_ids: np.ndarray, k: int) -> np.ndarray:
    """Boolean mask of the k smallest per row by (round(d, 9), id)."""
    R = np.round(D, 9)
    n = D.shape[1]
    if n <= k:
        return np.ones_like(D, dtype=bool)
    kth = np.partition(R, k - 1, axis=1)[:, k - 1]
    mask = R <= kth[:, None]
    for r in np.flatnonzero(mask.sum(axis=1) > k):  # rows with ties at the cut only
        cand = np.flatnonzero(mask[r])
        keep = cand[np.lexsort((col_ids[cand], R[r, cand]))[:k]]
        mask[r] = False
        mask[r, keep] = True
    return mask


# Above this dimension the scorer prefilters with a BLAS product.
PREFILTER_MIN_DIM = 32
_EXACT_CHUNK = 1 << 22          # elements of the (pairs x dims) difference buffer


def exact_pairs(Q: np.ndarray, C: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Ordered-sum squared distances for the listed (query, index) pairs only."""
    out = np.empty(len(qi), dtype=np.float64)
    step = max(1, _EXACT_CHUNK // max(1, Q.shape[1]))
    for s0 in range(0, len(qi), step):
        diff = Q[qi[s0:s0 + step]] - C[ci[s0:s0 + step]]
        acc = np.zeros(len(diff), dtype=np.float64)
        for j in range(diff.shape[1]):
            acc += diff[:, j] * diff[:, j]
        out[s0:s0 + step] = acc
    return out


def block_topk(Q: np.ndarray, C: np.ndarray, col_ids: np.ndarray, k: int):
    """``(qi, ci, d)`` of the k nearest per query row, exact under (round(d, 9), id).

    For high dimensions the expansion ``|q|² + |c|² - 2 q·c`` (one BLAS call)
    selects candidates within a margin that covers its rounding error twice
    and the 9-decimal tie band; only those pairs get exact ordered sums.
    """
    if Q.shape[1] < PREFILTER_MIN_DIM or C.shape[0] <= k:
        D = sq_distances(Q, C)
        qi, ci = np.nonzero(topk_mask(D, col_ids, k))
        return qi, ci, D[qi, ci]
    qn = np.einsum("ij,ij->i", Q, Q)
    cn = np.einsum("ij,ij->i", C, C)
    A = qn[:, None] + cn[None, :] - 2.0 * (Q @ C.T)
    kth = np.partition(A, k - 1, axis=1)[:, k - 1]
    tol = 1e-10 * (qn[:, None] + cn[None, :]) + 1e-12
    margin = 2.0 * tol.max(axis=1) + 2e-9
    qi, ci = np.nonzero(A <= (kth + margin)[:, None])
    d = exact_pairs(Q, C, qi, ci)
    E = np.full(A.shape, np.inf)
    E[qi, ci] = d
    keep = topk_mask(E, col_ids, k) & np.isfinite(E)
    qi, ci = np.nonzero(keep)
    return qi, ci, E[qi, ci]


def id_array(ids) -> np.ndarray:
    """Ids of a block: an integer array, or Python strings."""
    a = np.asarray(ids)
    return a if a.dtype.kind in "iu" else np.array(ids, dtype=object)


def id_ranks(ids: np.ndarray) -> np.ndarray:
    """Integers in the order of the ids (strings by code point, as Spark orders them)."""
    if ids.dtype.kind != "O":
        return ids
    ranks = np.empty(len(ids), dtype=np.int64)
    ranks[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return ranks


def _pair_scorer(k: int):
    def score(batches):
        for pdf in batches:
            outs = []
            for row in pdf.itertuples(index=False):  # one row per block pair
                if row.l_dim != row.r_dim:
                    raise ValueError(f"query dim {row.l_dim} != index dim {row.r_dim}")
                Q = np.frombuffer(row.l_mat, dtype=np.float64).reshape(row.l_n, row.l_dim)
                C = np.frombuffer(row.r_mat, dtype=np.float64).reshape(row.r_n, row.r_dim)
                lid, rid = id_array(row.l_ids), id_array(row.r_ids)
                qi, ci, d = block_topk(Q, C, id_ranks(rid), k)
                outs.append(pd.DataFrame({"query_id": lid[qi], "neighbor_id": rid[ci], "distance": d}))
            if outs:
                yield pd.concat(outs, ignore_index=True)
    return score


def _prefix(blocks: DataFrame, p: str) -> DataFrame:
    return blocks.select("stripe", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "dim", "ids", "mat")])


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str,
                right_vec: str, block_rows: int = 1024, broadcast_rows: int | None = None,
                stripes: int | None = None, broadcast: str | None = None) -> DataFrame:
    """Every (left block, right block) pair as one row: ``stripe, l_n, l_dim, l_ids,
    l_mat, r_n, r_dim, r_ids, r_mat``.  Placement as described in the module doc;
    ``broadcast="right"`` skips the size check when the caller already proved it."""
    spark = left.sparkSession
    L = left.select(F.col(left_id).alias("_lid"), F.col(left_vec).alias("_lv"))
    R = right.select(F.col(right_id).alias("_rid"), F.col(right_vec).alias("_rv"))
    if broadcast is None and broadcast_rows is None:
        broadcast_rows = broadcast_row_bound(R, "_rv")
    if broadcast == "right" or (broadcast is None and is_bounded(R, broadcast_rows)):
        lb = _prefix(pack_blocks(L, "_lid", "_lv", block_rows), "l")
        rb = _prefix(pack_blocks(R, "_rid", "_rv", block_rows), "r")
        return lb.join(F.broadcast(rb), "stripe")
    if broadcast is None and is_bounded(L, broadcast_rows):
        lb = _prefix(pack_blocks(L, "_lid", "_lv", block_rows), "l")
        rb = _prefix(pack_blocks(R, "_rid", "_rv", block_rows), "r")
        return rb.join(F.broadcast(lb), "stripe")
    s = stripes or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n_left, n_right = L.count(), R.count()
    seq = F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("stripe")
    if n_left <= n_right:   # replicate the smaller side to every stripe
        lb = _prefix(pack_blocks(L, "_lid", "_lv", block_rows), "l")
        lb = lb.select(seq, *[c for c in lb.columns if c != "stripe"])
        rb = _prefix(pack_blocks(R, "_rid", "_rv", block_rows, stripes=s), "r")
    else:
        lb = _prefix(pack_blocks(L, "_lid", "_lv", block_rows, stripes=s), "l")
        rb = _prefix(pack_blocks(R, "_rid", "_rv", block_rows), "r")
        rb = rb.select(seq, *[c for c in rb.columns if c != "stripe"])
    return lb.join(rb, "stripe")


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str = "id", right_id: str = "id",
             left_vec: str = "vector", right_vec: str = "vector", block_rows: int = 1024,
             broadcast_rows: int | None = None, stripes: int | None = None) -> DataFrame:
    """For each ``left`` row, its ``k`` nearest ``right`` rows (exact, squared L2).

    Returns ``(query_id, neighbor_id, distance, rank)``; fewer than ``k`` rows
    for a query when ``right`` is smaller than ``k`` (never filler rows).
    """
    if k <= 0:
        raise ValueError("k must be positive")
    pairs = block_pairs(left, right, left_id, right_id, left_vec, right_vec, block_rows, broadcast_rows, stripes)
    return pair_topk(pairs, k)


def pair_topk(pairs: DataFrame, k: int, dedup: bool = False) -> DataFrame:
    """Score joined block pairs and keep the k nearest per query.

    ``dedup`` drops repeated (query, neighbour) rows first, for probes that can
    meet the same neighbour through several cells or hash tables.
    """
    left, right = (pairs.schema[c].dataType.elementType.simpleString() for c in ("l_ids", "r_ids"))
    cand = pairs.mapInPandas(_pair_scorer(k), f"query_id {left}, neighbor_id {right}, distance double")
    if dedup:
        cand = cand.dropDuplicates(["query_id", "neighbor_id"])
    return top_per_group(cand, ["query_id"], [F.round("distance", 9), F.col("neighbor_id")], k)


# ----------------------------------------------------------------- top-k
def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group in ``order`` (WIN1-3).

    ``row_number`` filtered by a constant is planned as a partial
    ``WindowGroupLimit`` before the shuffle, so a hot group sends at most
    ``k`` rows per partition.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def top_overall(df: DataFrame, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Global top-k with a rank column (``TakeOrderedAndProject`` then numbering)."""
    top = df.orderBy(*order).limit(k)
    w = Window.orderBy(*order)  # at most k rows reach this window
    return top.withColumn(rank_col, F.row_number().over(w))


def assign_nearest(points: DataFrame, centers: DataFrame, point_id: str = "paper_id",
                   center_id: str = "cluster_id", point_vec: str = "vector",
                   center_vec: str = "centroid", **kw) -> DataFrame:
    """Nearest centre of every point (JN4): ``(point_id, center_id, distance)``."""
    nn = knn_join(points, centers, 1, point_id, center_id, point_vec, center_vec, **kw)
    return nn.select(F.col("query_id").alias(point_id), F.col("neighbor_id").alias(center_id), "distance")
