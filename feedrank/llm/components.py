"""Connected components over a written edge table, keyed by 64-bit nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

ROUNDS = 200        # alternating rounds shrink every path to a star in about log2(length) of them


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``edges (src, dst)``; ``label`` is the smallest node of its component.

    Alternating star contraction: a node's larger neighbours are linked to its
    smallest one (large star), then its smaller neighbours are (small star).
    Both keep the connectivity; edges become stars around the smallest nodes.
    Partial aggregation bounds what a node of many edges shuffles.  Raises if
    the stars are not stable after ``ROUNDS`` rounds.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    edges = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"),
                                                  F.least("src", "dst").alias("dst")).distinct(), "edges")
    for _ in range(ROUNDS):
        around = both(edges)
        least = around.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        large = (around.filter("dst > src").join(least, "src")
                 .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src")
        new = (small.filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
               .unionByName(least.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct())
        new = cut(new, "edges")
        a, b = _mark(edges), _mark(new)
        edges = new
        if a == b:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Order-free digest of an edge set (count and two hash sums)."""
    h = F.xxhash64("src", "dst")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 34)), F.bit_xor(h)).first())
