"""Embedding whitening from a polarisation covariance.

Entries become integers ``x = floor(64 * c) + 1000000``.  Two passes aggregate
integers only, so sums are exact and do not depend on the order of tasks:

1. row count and per-dimension sums ``S``;
2. squared centred values of every dimension, ``sum y_i^2``, and of every
   dimension-pair sum, ``sum (y_i + y_j)^2``.

``y = x - m`` is centred at the whole number ``m`` nearest the mean; what is
left of the mean is taken out of the totals in whole numbers:
``n * sum y^2 - (sum y)^2 = sum (n x - S)^2 / n``.  Cross-covariances are
differences of variances: ``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2``.
Each is one division of whole numbers, rounded once.  The matrix is as large as
the square of the dimension, never of the table, and goes to ``eigh``.

A third pass measures the covariance of the whitened rows, a last one returns
them.  Nothing but totals is shuffled, so no vector or key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .common import arrow_schema, to_batch

SCALE, SHIFT = 64, 1_000_000
BLOCK = 1_024                    # rows squared at a time
LIMB = 60                        # totals travel as digits of this many bits
LARGEST = 2.0 ** 62              # entries whose scaled value reaches this have no long x
EXACT = float(1 << 53)           # whole numbers below this are exact as doubles
TOTALS = "dim int, i int, j int, limb int, value decimal(38,0)"


def whole(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)`` per vector length: row numbers and int64 matrix of the usable vectors of a list column.

    Null vectors and vectors with a null, non-finite or (as a scaled long) unrepresentable entry are left out.
    """
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()                              # of non-null lists only
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    c = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) * SCALE
    bad = bad | ~(np.abs(c) < LARGEST)
    end = np.cumsum(np.maximum(size, 0))
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        at = (end[rows] - d)[:, None] + np.arange(d)
        good = ~bad[at].any(axis=1)
        if good.any():
            yield rows[good], np.floor(c[at[good]]).astype(np.int64) + SHIFT


def _limbs(dim: int, names: list[tuple[int, int]], totals: list[int]) -> dict:
    """Total table rows; a total is the sum of ``value << (LIMB * limb)``."""
    out: dict[str, list] = {"dim": [], "i": [], "j": [], "limb": [], "value": []}
    for (i, j), total in zip(names, totals):
        sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
        while rest or not limb:
            for name, value in zip(out, (dim, i, j, limb, sign * (rest & ((1 << LIMB) - 1)))):
                out[name].append(value)
            rest >>= LIMB
            limb += 1
    return out


def _summed(parts: DataFrame) -> DataFrame:
    return cut(parts.groupBy("dim", "i", "j", "limb").agg(F.sum("value").alias("value")), "whitening-totals")


def _read(table: DataFrame) -> dict[tuple[int, int], int]:
    got: dict[tuple[int, int], int] = {}
    for r in table.collect():
        got[r["i"], r["j"]] = got.get((r["i"], r["j"]), 0) + (int(r["value"]) << (LIMB * r["limb"]))
    return got


def _sum(x: np.ndarray) -> list[int]:
    """Exact column sums of an int64 matrix of at most ``BLOCK`` rows."""
    if len(x) and np.abs(x).max() < LARGEST / BLOCK:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(map(int, col)) for col in x.T]


def pair_squares(y: np.ndarray) -> list[int]:
    """Exact sums over the rows of ``y_i^2`` (all i), then of ``(y_i + y_j)^2`` (all i < j)."""
    top = int(np.abs(y).max()) if y.size else 0
    if 4 * top * top * max(len(y), 1) < EXACT:
        t = np.ascontiguousarray(y.T, dtype=np.float64)
        parts = [np.einsum("ij,ij->i", t, t)]
        for i in range(len(t) - 1):
            s = t[i + 1:] + t[i]
            parts.append(np.einsum("ij,ij->i", s, s))
        return np.concatenate(parts).astype(np.int64).tolist()
    t = [[int(v) for v in col] for col in y.T]
    out = [sum(v * v for v in col) for col in t]
    return out + [sum((a + b) ** 2 for a, b in zip(t[i], t[j])) for i in range(len(t)) for j in range(i + 1, len(t))]


def pair_names(d: int) -> list[tuple[int, int]]:
    return [(i, -1) for i in range(d)] + [(i, j) for i in range(d) for j in range(i + 1, d)]


def first_totals(vectors: DataFrame) -> DataFrame:
    """Per vector length: ``(-1, -1)`` the row count, ``(i, -1)`` the sum of dimension i."""
    schema = arrow_schema(TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                for rows, x in whole(b.column("v").slice(at, BLOCK)):
                    t = totals.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
                    for k, v in enumerate([len(rows), *_sum(x)]):
                        t[k] += v
        for d, t in totals.items():
            yield to_batch(_limbs(d, [(-1, -1), *((i, -1) for i in range(d))], t), schema)

    return _summed(vectors.mapInArrow(run, TOTALS))


def second_totals(vectors: DataFrame, middle: np.ndarray) -> DataFrame:
    """Squares of centred dimensions and dimension-pair sums (:func:`pair_squares`)."""
    schema, d = arrow_schema(TOTALS), len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                for _, x in whole(b.column("v").slice(at, BLOCK)):
                    if x.shape[1] == d:
                        part = pair_squares(x - middle)
                        total = part if total is None else [a + c for a, c in zip(total, part)]
        if total is not None:
            yield to_batch(_limbs(d, pair_names(d), total), schema)

    return _summed(vectors.mapInArrow(run, TOTALS))


class Whitening:
    """Sums and components of a fitted table; what a task needs to whiten rows."""

    def __init__(self, n: int, sums: list[int], middle: np.ndarray, squares: dict[tuple[int, int], int], most: int):
        d = len(sums)
        self.n, self.middle = n, middle
        self.rest = [s - n * int(m) for s, m in zip(sums, middle)]         # sum of y, exact
        own = [n * squares[i, -1] - self.rest[i] ** 2 for i in range(d)]   # n * n * variance
        cov = np.empty((d, d))
        for i in range(d):
            cov[i, i] = own[i] / (n * n)
            for j in range(i + 1, d):
                both = n * squares[i, j] - (self.rest[i] + self.rest[j]) ** 2
                cov[i, j] = cov[j, i] = (both - own[i] - own[j]) / (2 * n * n)
        self.cov = cov
        value, vector = np.linalg.eigh(cov)
        keep = np.argsort(-value, kind="stable")[:most]
        self.value, self.vector = value[keep], vector[:, keep]
        trace = float(np.trace(cov))
        self.live = self.value > max(float(value[-1]), 0.0) * d * np.finfo(float).eps
        self.explained = np.where(self.live, self.value / trace, 0.0) if trace > 0 else np.zeros(len(keep))
        self.weights = np.where(self.live, self.vector / np.sqrt(np.where(self.live, self.value, 1.0)), 0.0)
        self.offset = np.array([r / n for r in self.rest])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.offset) @ self.weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact ``sum (n x - S)^2`` of each row; None where it exceeds a long."""
        y = x - self.middle
        top = self.n * (int(np.abs(y).max()) if y.size else 0) + max(map(abs, self.rest))
        if top * top * len(self.middle) < 1 << 63:
            z = y * self.n - np.array(self.rest, np.int64)
            return (z * z).sum(axis=1).tolist()
        got = (sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest)) for row in y)
        return [v if v < 1 << 63 else None for v in got]


def fit(vectors: DataFrame, most: int = 32) -> Whitening | None:
    """Fit on all usable vectors of ``vectors (v)``; None when there is none.

    Vectors of another length than the most frequent one (the longest of equally frequent ones) are not comparable and left out.
    """
    first = first_totals(vectors)
    rows = F.sum(F.col("value") * F.when(F.col("limb") == 0, 1).otherwise(0))
    lengths = first.filter("i = -1 and limb = 0").groupBy("dim").agg(rows.alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["dim"]
    got = _read(first.filter(F.col("dim") == d))
    n, sums = got[-1, -1], [got[i, -1] for i in range(d)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    squares = _read(second_totals(vectors, middle))
    return Whitening(n, sums, middle, squares, most)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the measured covariance of the whitened rows minus the identity.

    Over the components with a positive eigenvalue; 0 when there is none.
    """
    d, k = model.weights.shape
    schema = "i int, j int, value double"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                for _, x in whole(b.column("v").slice(at, BLOCK)):
                    if x.shape[1] == d:
                        z = model.whiten(x)
                        s += z.sum(axis=0)
                        q += z.T @ z
        i, j = np.indices((k, k))
        yield to_batch({"i": np.concatenate([np.arange(k), i.ravel()]), "j": np.concatenate([np.full(k, -1), j.ravel()]),
                        "value": np.concatenate([s, q.ravel()])}, arrow)

    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in vectors.mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if r["j"] < 0:
            mean[r["i"]] = r["value"] / model.n
        else:
            cov[r["i"], r["j"]] = r["value"] / model.n
    off = (cov - np.outer(mean, mean) - np.eye(k))[np.ix_(model.live, model.live)]
    return float(np.abs(off).max()) if off.size else 0.0


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """Per usable row and component (at most ``most``) its whitened value, with the fit's figures.

    ``(id, component, n, deviation, whitened, explained, identity_error)``.
    Rows whose vector is null, or holds a null, non-finite or unrepresentable
    entry, are dropped from fit and result, as are vectors of another length
    than the most frequent one and empty ones; ids may be null or repeated.  A
    component without variance (constant dimensions, a single row, repeated rows
    only) has whitened and explained 0.  ``deviation`` is null where it exceeds
    a long.  An empty table gives no row; extra columns are ignored.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{vector_col}`").alias("v"))
    out = (f"k {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
           "explained double, identity_error double")
    schema = arrow_schema(out)
    model = fit(rows.select("v"), most)
    if model is None:
        return df.sparkSession.createDataFrame([], out).withColumnRenamed("k", id_col)
    error = identity_error(rows.select("v"), model)
    d, k = model.weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                for row, x in whole(part.column("v")):
                    if x.shape[1] != d:
                        continue
                    m = len(row)
                    yield to_batch({
                        "k": part.column("k").take(pa.array(np.repeat(row, k))),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, model.n, np.int64),
                        "deviation": pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        "whitened": model.whiten(x).ravel(), "explained": np.tile(model.explained, m),
                        "identity_error": np.full(m * k, error)}, schema)

    return rows.mapInArrow(run, out).withColumnRenamed("k", id_col)
