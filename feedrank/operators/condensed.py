"""Exact condensed tree and excess-of-mass labels of a spanning forest, at any size (CL2).

Edges are cut into weight bands of about ``band_edges`` edges; edges of equal
weight stay together.  What a band does to the hierarchy depends only on the
components below it, so bands are solved independently once every edge's ends are
named by the component they belong to below the band.  Those names come from
halving: the lighter half of the bands is contracted (connected components), the
heavier half takes the names, both halves go on side by side -- ``log2(bands)``
rounds whatever the number of distinct weights.

A band of bounded size is solved in one task, by merging along ascending weight
(all edges of a weight at once).  Equal weights beyond the bound are one merge and
are solved by joins and aggregates instead.  Both give *pieces*: stretches of a
condensed cluster inside one band.  Pieces that go on in a later band are chained
by pointer doubling.

Stability is summed as ``size * (lambda_i - lambda_i+1)`` from event to event, so
nothing cancels.  Selection runs over classes ``floor(log2(size))``: at most one
child of a cluster is in its own class, so clusters of a class form chains, which
are walked in a stream, bottom-up for the best mass and top-down for the labels;
there are at most ``log2(n)`` classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .lineage import cut
from .sequence import with_sequence

MIN_WEIGHT = 1e-12
BAND_EDGES = 200_000         # edges solved by one task

# a stretch of a cluster: id, the piece it merges into (same band), lambda of that merge (null: open at the band's
# end), its share of the stability, smallest member and size at its end, and the node it goes on from (null: born here)
# (the fate of a node: the first piece in which it is part of a cluster, its lambda, or the component it ends in)
PIECE = "band int, pid string, up string, birth double, stability double, rep bigint, size bigint, node bigint"


def lam_of(w):
    return 1.0 / max(w, MIN_WEIGHT)


class _Band:
    """Merging of one band's components along ascending weight."""

    def __init__(self, band: int, sizes: dict[int, int], least: int, opened: float, closed: float):
        self.band, self.least, self.closed = band, least, closed
        self.parent = {v: v for v in sizes}
        self.size = dict(sizes)
        self.rep = {v: v for v in sizes}
        self.piece: dict[int, int] = {}                # component root -> open piece
        self.small: dict[int, list[int]] = {}          # component root -> nodes in no cluster yet
        self.rows: list[list] = []
        self.fate: dict[int, tuple[int, float]] = {}
        for v, n in sizes.items():
            if n >= least:
                self.piece[v] = self._open(v, n, opened, v)
                self.fate[v] = (self.piece[v], float("inf"))
            else:
                self.small[v] = [v]

    def _open(self, rep: int, size: int, at: float, node: int | None) -> int:
        self.rows.append([None, None, 0.0, rep, size, node, at])       # up, birth, stability, rep, size, node, last lambda
        return len(self.rows) - 1

    def _age(self, p: int, lam: float) -> list:
        row = self.rows[p]
        row[2] += row[4] * (row[6] - lam)
        row[6] = lam
        return row

    def find(self, v: int) -> int:
        while self.parent[v] != v:
            self.parent[v] = self.parent[self.parent[v]]
            v = self.parent[v]
        return v

    def merge(self, edges: list[tuple[int, int]], lam: float) -> None:
        """All edges of one weight at once."""
        parts: dict[int, list[int]] = {}
        for u, v in edges:
            for x in (self.find(u), self.find(v)):
                parts.setdefault(x, [x])
        before = list(parts)
        for u, v in edges:
            a, b = self.find(u), self.find(v)
            if a != b:
                if len(parts[a]) < len(parts[b]):
                    a, b = b, a
                self.parent[b] = a
                parts[a] += parts.pop(b)
        for root in {self.find(x) for x in before}:
            held = parts[root]
            if len(held) < 2:
                continue
            size, rep = sum(self.size[x] for x in held), min(self.rep[x] for x in held)
            big = [self.piece.pop(x) for x in held if x in self.piece]
            small = [self.small.pop(x) for x in held if x in self.small]
            self.size[root], self.rep[root] = size, rep
            if size < self.least:
                self.small[root] = max(small, key=len)
                for x in small:
                    if x is not self.small[root]:
                        self.small[root] += x
                continue
            if len(big) == 1:
                p = big[0]
                self._age(p, lam)
                self.rows[p][3:5] = [rep, size]
            else:                                      # a cluster's lower end: born from small parts, or split here
                p = self._open(rep, size, lam, None)
                for q in big:
                    self._age(q, lam)[:2] = [p, lam]
            for nodes in small:
                for v in nodes:
                    self.fate[v] = (p, lam)
            self.piece[root] = p

    def result(self) -> list[tuple]:
        """Rows of pieces (kind 0) and fates (kind 1)."""
        name = lambda p: None if p is None else f"{self.band}:{p}"
        for p in self.piece.values():
            self._age(p, self.closed)
        out = [(0, self.band, name(p), name(r[0]), r[1], r[2], r[3], r[4], r[5], None, None) for p, r in enumerate(self.rows)]
        out += [(1, self.band, name(p), None, None, None, None, None, v, lam, None) for v, (p, lam) in self.fate.items()]
        for root, nodes in self.small.items():
            out += [(1, self.band, None, None, None, None, None, None, v, None, self.rep[root]) for v in nodes]
        return out


def _bands(edges: DataFrame, band_edges: int) -> tuple[DataFrame, DataFrame]:
    """``(edges with band, bands)``: ``bands (band, n, opened, closed, flat)``, lightest first.

    ``opened`` is lambda at the end of the band below, ``closed`` at the own end;
    ``flat`` bands hold one weight with more edges than a task takes.
    """
    n = edges.count()
    number = max(1, -(-n // band_edges))
    heavy = [r["w"] for r in edges.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > band_edges).collect()]              # fewer than ``number`` weights
    cuts = set()
    if number > 1:
        row = edges.agg(F.percentile_approx("w", [i / number for i in range(1, number)], 10 * number).alias("q")).first()
        cuts = set(row["q"])
    # a band is [cut, next cut); a heavy weight has a band of its own
    cuts = sorted(cuts | set(heavy) | {math.nextafter(w, math.inf) for w in heavy})
    spark = edges.sparkSession
    limits = np.array(cuts, dtype=float)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(band=np.searchsorted(limits, pdf["w"].to_numpy(), side="right").astype(np.int32))

    placed = cut(edges.select("u", "v", "w").mapInPandas(place, "u bigint, v bigint, w double, band int"), "tree-edges")
    found = sorted((r["band"], r["n"], r["top"], r["low"]) for r in placed.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.max("w").alias("top"), F.min("w").alias("low")).collect())      # one row a band
    rows, opened = [], float("inf")
    for band, count, top, low in found:
        rows.append((band, count, opened, lam_of(top), low == top and count > band_edges))
        opened = lam_of(top)
    return placed, spark.createDataFrame(rows, "band int, n bigint, opened double, closed double, flat boolean")


def _named(edges: DataFrame, bands: list[int]) -> tuple[DataFrame, DataFrame]:
    """Ends of every edge named by their component below its band: ``(edges (band, u, v, w), sizes (band, node, size))``.

    A component is named by its smallest point.
    """
    one = edges.select("u", "v", "w", "band", F.lit(0).alias("seg"))
    ends = lambda e, *keys: e.select(*keys, F.col("u").alias("node")).unionByName(
        e.select(*keys, F.col("v").alias("node"))).distinct()
    sizes = ends(one, "seg").withColumn("size", F.lit(1).cast("bigint"))
    spans = {0: (0, len(bands))}                        # segment -> places of its bands
    while any(b - a > 1 for a, b in spans.values()):
        middle = {s: (a + b) // 2 for s, (a, b) in spans.items() if b - a > 1}
        spark = edges.sparkSession
        pivots = F.broadcast(spark.createDataFrame([(s, bands[m]) for s, m in middle.items()], "seg int, pivot int"))  # one row a band
        side = one.join(pivots, "seg", "left").withColumn("heavy", F.coalesce(F.col("band") >= F.col("pivot"), F.lit(False)))
        light = side.filter(~F.col("heavy") & F.col("pivot").isNotNull())
        label = cut(connected_components(ends(light, "seg"), light.select("seg", F.col("u").alias("src"), F.col("v").alias("dst")),
                                         keys=["seg"]), "tree-names")
        as_ = lambda c: label.select("seg", F.col("node").alias(c), F.col("label").alias(f"{c}_new"))
        moved = (side.filter("heavy").join(as_("u"), ["seg", "u"], "left").join(as_("v"), ["seg", "v"], "left")
                 .select((2 * F.col("seg") + 1).alias("seg"), F.coalesce("u_new", "u").alias("u"),
                         F.coalesce("v_new", "v").alias("v"), "w", "band"))
        stay = side.filter(~F.col("heavy")).select((2 * F.col("seg")).alias("seg"), "u", "v", "w", "band")
        one = cut(stay.unionByName(moved), "tree-named")
        grown = (sizes.join(label, ["seg", "node"], "left").groupBy((2 * F.col("seg") + 1).alias("seg"), F.coalesce("label", "node").alias("node"))
                 .agg(F.sum("size").alias("size")))
        both = sizes.select((2 * F.col("seg")).alias("seg"), "node", "size").unionByName(grown)
        sizes = cut(both.join(ends(one, "seg"), ["seg", "node"], "left_semi"), "tree-sizes")
        spans = {k: v for s, (a, b) in spans.items() for k, v in (
            ((2 * s, (a, middle[s])), (2 * s + 1, (middle[s], b))) if s in middle else ((2 * s, (a, b)),))}
    owner = {s: bands[a] for s, (a, b) in spans.items() if b > a}
    spark = edges.sparkSession
    names = F.broadcast(spark.createDataFrame(list(owner.items()), "seg int, band int"))     # one row a band
    return one.select("band", "u", "v", "w"), sizes.join(names, "seg").select("band", "node", "size")


def _solved(edges: DataFrame, sizes: DataFrame, bands: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Pieces and fates of the bounded bands, one task a band."""
    lines = edges.select("band", "u", "v", "w", F.lit(None).cast("bigint").alias("size")).unionByName(
        sizes.select("band", F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("double").alias("w"), "size"))
    work = lines.join(F.broadcast(bands.filter("not flat").select("band", "opened", "closed")), "band")
    out = f"kind int, {PIECE}, lam double, root bigint"
    names = [c.split()[0] for c in out.split(", ")]
    whole = ("rep", "size", "node", "root")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, e = pdf[pdf["v"].isna()], pdf[pdf["v"].notna()].sort_values("w")
        b = _Band(int(pdf["band"].iloc[0]), dict(zip(nodes["u"].tolist(), nodes["size"].astype("int64").tolist())), least,
                  float(pdf["opened"].iloc[0]), float(pdf["closed"].iloc[0]))
        w = e["w"].to_numpy()
        ends = list(zip(e["u"].tolist(), e["v"].astype("int64").tolist()))
        at = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(w)]
        for x, y in zip(at, at[1:]):
            b.merge(ends[x:y], lam_of(float(w[x])))
        return pd.DataFrame({c: pd.array(col, dtype="Int64") if c in whole else col for c, col in zip(names, zip(*b.result()))})

    got = cut(work.groupBy("band").applyInPandas(solve, out), "tree-bands")
    return (got.filter("kind = 0").select(*[f.split()[0] for f in PIECE.split(", ")]),
            got.filter("kind = 1").select("band", "node", "pid", "lam", "root"))


def _flat(edges: DataFrame, sizes: DataFrame, bands: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The same for bands of one weight, by joins: every component of their edges is one merge."""
    flat = F.broadcast(bands.filter("flat").select("band", "opened", "closed"))
    e = edges.join(flat.select("band"), "band")
    nodes = sizes.join(flat, "band")
    label = connected_components(nodes.select("band", "node"), e.select("band", F.col("u").alias("src"), F.col("v").alias("dst")), keys=["band"])
    part = cut(nodes.join(label, ["band", "node"]), "tree-flat")
    whole = part.groupBy("band", "label").agg(F.sum("size").alias("total"), F.sum((F.col("size") >= least).cast("int")).alias("bigs"),
                                              F.min(F.when(F.col("size") >= least, F.col("node"))).alias("one"))
    part = part.join(whole, ["band", "label"])
    own = lambda c: F.concat_ws(":", F.col("band").cast("string"), F.lit("n"), F.col(c).cast("string"))
    merged = F.concat_ws(":", F.col("band").cast("string"), F.lit("m"), F.col("label").cast("string"))
    big = F.col("size") >= least
    alone = F.col("bigs") == 1                         # the one big part goes on
    none = F.lit(None)
    pieces = part.filter(big).select(
        "band", own("node").alias("pid"), F.when(~alone, merged).alias("up"), F.when(~alone, F.col("closed")).alias("birth"),
        (F.col("size") * F.when(F.isnan(F.col("opened")) | (F.col("opened") == float("inf")), 0.0).otherwise(F.col("opened") - F.col("closed"))).alias("stability"),
        F.when(alone, F.col("label")).otherwise(F.col("node")).alias("rep"), F.when(alone, F.col("total")).otherwise(F.col("size")).alias("size"), "node")
    tops = part.filter((F.col("total") >= least) & ~alone).select("band", "label", "total").distinct().select(
        "band", merged.alias("pid"), none.cast("string").alias("up"), none.cast("double").alias("birth"), F.lit(0.0).alias("stability"),
        F.col("label").alias("rep"), F.col("total").alias("size"), none.cast("bigint").alias("node"))
    fates = part.select("band", "node", F.when(big, own("node")).when(F.col("total") >= least, F.when(alone, own("one")).otherwise(merged)).alias("pid"),
                        F.when(big, F.lit(float("inf"))).when(F.col("total") >= least, F.col("closed")).alias("lam"),
                        F.when(F.col("total") < least, F.col("label")).alias("root"))
    return pieces.unionByName(tops), fates


def _jump(links: DataFrame, key: str, to: str, rounds: int) -> DataFrame:
    """Follow ``key -> to`` links to their ends by doubling: ``(key, to)``; ends have no row of their own."""
    for _ in range(rounds):
        nxt = links.select(F.col(key).alias(to), F.col(to).alias("_to"))
        links = cut(links.join(nxt, to, "left").select(key, F.coalesce("_to", to).alias(to)), "tree-jump")
    return links


def _stream(df: DataFrame, order: list, run, schema: str) -> DataFrame:
    """``run`` over each chain's rows in order, chains one after the other."""
    return df.repartition("chain").sortWithinPartitions("chain", *order).mapInPandas(run, schema)


def _best(tree: DataFrame, rounds: list[int]) -> DataFrame:
    """``(cid, best, selected)``: the larger of a cluster's own stability and its children's best, bottom-up by class."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, below = None, 0.0
        for pdf in batches:
            best, chosen = [], []
            for c, s, kids in zip(pdf["chain"], pdf["stability"], pdf["kids"]):
                if c != chain:
                    chain, below = c, 0.0
                kids += below
                chosen.append(s >= kids)
                below = max(s, kids)
                best.append(below)
            yield pd.DataFrame({"cid": pdf["cid"], "best": best, "selected": chosen})

    done = None
    for k in rounds:
        rows = tree.filter(F.col("class") == k)
        if done is None:
            rows = rows.withColumn("kids", F.lit(0.0))
        else:       # children in the same class are the chain's next rows
            sums = done.join(tree.select("cid", "pcid", F.col("class").alias("of")), "cid").filter(F.col("of") < k) \
                .groupBy(F.col("pcid").alias("cid")).agg(F.sum("best").alias("kids"))
            rows = rows.join(sums, "cid", "left").withColumn("kids", F.coalesce("kids", F.lit(0.0)))
        got = _stream(rows.select("cid", "chain", "birth", "stability", "kids"), [F.desc("birth")], run,
                      "cid string, best double, selected boolean")
        done = cut(got if done is None else done.unionByName(got), "tree-best")
    return done


def _chosen(tree: DataFrame, rounds: list[int]) -> DataFrame:
    """``(cid, cas)``: the highest selected cluster above or at each one (null: none), top-down by class."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, above = None, None
        for pdf in batches:
            out = []
            for c, cid, sel, given in zip(pdf["chain"], pdf["cid"], pdf["selected"], pdf["given"]):
                if c != chain:
                    chain, above = c, (given if isinstance(given, str) else None)
                above = above or (cid if sel else None)
                out.append(above)
            yield pd.DataFrame({"cid": pdf["cid"], "cas": pd.Series(out, dtype=object)})

    done = None
    for k in reversed(rounds):
        rows = tree.filter(F.col("class") == k)
        if done is None:
            rows = rows.withColumn("given", F.lit(None).cast("string"))
        else:
            rows = rows.join(done.select(F.col("cid").alias("pcid"), F.col("cas").alias("given")), "pcid", "left")
        got = _stream(rows.select("cid", "chain", "birth", "selected", "given"), [F.asc("birth")], run, "cid string, cas string")
        done = cut(got if done is None else done.unionByName(got), "tree-chosen")
    return done


def condensed_tree(edges: DataFrame, min_cluster_size: int, band_edges: int = BAND_EDGES) -> tuple[DataFrame, DataFrame] | None:
    """``(tree, points)`` of a spanning forest ``(u, v, w)``; None when there is no edge.

    ``tree (cid, pcid, birth, stability, min_node, size)``: every condensed
    cluster; roots have no ``pcid`` and birth 0.  ``points (node, cid, lam)``: the
    deepest cluster of every point and the lambda at which it leaves it, null
    for points that are in none.
    """
    placed, bands = _bands(edges, band_edges)
    listed = sorted((r["band"], r["flat"], r["closed"], r["opened"]) for r in bands.collect())      # one row a band
    if not listed:
        return None
    order = [b for b, _, _, _ in listed]
    named, sizes = _named(placed, order)
    pieces, fates = _solved(named, sizes, bands, min_cluster_size)
    if any(flat for _, flat, _, _ in listed):
        more, ends = _flat(named, sizes, bands, min_cluster_size)
        pieces, fates = pieces.unionByName(more), fates.unionByName(ends)
    if len(order) > 1:
        pieces, fates = cut(pieces, "tree-pieces"), cut(fates, "tree-fates")
    rounds = max(0, math.ceil(math.log2(len(order))))
    # an open piece goes on where its component is next a node of a band
    after = fates.select(F.col("node").alias("rep"), F.col("band").alias("there"))
    opens = pieces.filter("up is null").select("pid", "rep", "size", "band")
    first = (opens.join(after, "rep").filter("there > band").groupBy("pid", "rep", "size", "band").agg(F.min("there").alias("there")))
    goes = (first.join(pieces.filter("node is not null").select(F.col("node").alias("rep"), F.col("band").alias("there"), F.col("pid").alias("on")),
                       ["rep", "there"]))
    facts = F.broadcast(bands.select("band", "opened", "closed"))                                   # one row a band
    gap = (goes.join(facts.select("band", "closed"), "band")
           .join(facts.select(F.col("band").alias("there"), "opened"), "there")
           .select("pid", "on", (F.col("size") * (F.col("closed") - F.col("opened"))).alias("gap")))
    gap = cut(gap, "tree-gaps")
    top = _jump(gap.select("pid", "on"), "pid", "on", rounds)
    pieces = pieces.join(top.select("pid", F.col("on").alias("cid")), "pid", "left").withColumn("cid", F.coalesce("cid", "pid"))
    pieces = pieces.join(gap.select("pid", "gap"), "pid", "left")
    pieces = cut(pieces, "tree-clusters")
    mass = pieces.groupBy("cid").agg(F.sum(F.col("stability") + F.coalesce("gap", F.lit(0.0))).alias("stability"))
    ends = pieces.filter("pid = cid").select("cid", "up", F.coalesce("birth", F.lit(0.0)).alias("birth"), F.col("rep").alias("min_node"), "size")
    of = pieces.select(F.col("pid").alias("up"), F.col("cid").alias("pcid"))
    tree = cut(ends.join(of, "up", "left").join(mass, "cid").select("cid", "pcid", "birth", "stability", "min_node", "size"), "tree-table")
    # a point's own node is followed through the components it ends in until one of them joins a cluster
    steps = fates.filter("pid is null").select(F.col("node").alias("was"), "band", F.col("root").alias("rep"))
    nxt = (steps.join(after, "rep").filter("there > band").groupBy("was", "band", "rep").agg(F.min("there").alias("there")))
    at = lambda b, v: F.struct(F.col(b).alias("band"), F.col(v).alias("node"))
    links = nxt.select(at("band", "was").alias("here"), at("there", "rep").alias("next"))
    if rounds:
        links = _jump(cut(links, "tree-links"), "here", "next", rounds)
    start = fates.groupBy("node").agg(F.min("band").alias("band")).select(F.col("node").alias("point"), at("band", "node").alias("here"))
    found = start.join(links, "here", "left").select("point", F.coalesce("next", "here").alias("at"))
    final = fates.select(at("band", "node").alias("at"), "pid", "lam")
    points = found.join(final, "at").join(pieces.select("pid", "cid"), "pid", "left").select(F.col("point").alias("node"), "cid", "lam")
    return tree, points


def label_points(ids: DataFrame, edges: DataFrame, min_cluster_size: int, id_col: str = "id",
                 band_edges: int = BAND_EDGES) -> DataFrame:
    """Labels ``(id, cluster_id)`` by excess of mass; -1 is noise, clusters are numbered by their smallest member.

    A root is never selected.  Points of no edge are noise.
    """
    nodes = ids.select(F.col(id_col).alias("node"))
    built = condensed_tree(edges, min_cluster_size, band_edges)
    if built is None:
        return nodes.select(F.col("node").alias(id_col), F.lit(-1).alias("cluster_id"))
    tree, points = built
    tree = tree.withColumn("class", F.floor(F.log2("size") + 1e-9).cast("int"))
    # chains: clusters linked to a parent of their class; the string ids are numbered by their smallest member and size
    same = tree.join(tree.select(F.col("cid").alias("pcid"), F.col("class").alias("pclass")), "pcid").filter("class = pclass")
    number = F.xxhash64("cid")
    lines = same.select(number.alias("src"), F.xxhash64("pcid").alias("dst"))
    chain = connected_components(tree.select(number.alias("node")), lines)
    tree = cut(tree.withColumn("node", number).join(chain, "node").withColumnRenamed("label", "chain").drop("node"), "tree-chains")
    rounds = [r["class"] for r in tree.select("class").distinct().orderBy("class").collect()]       # at most log2(n)
    tree = tree.withColumn("root", F.col("pcid").isNull())
    picked = tree.join(_best(tree, rounds).select("cid", "selected"), "cid").withColumn("selected", F.col("selected") & ~F.col("root"))
    picked = cut(picked, "tree-picked")
    cas = _chosen(picked, rounds)
    chosen = cas.filter("cas = cid").join(tree.select("cid", "min_node"), "cid")
    numbered = with_sequence(chosen.select("cid", "min_node"), "min_node", out="cluster_id")
    label = (points.join(cas, "cid").join(numbered.select(F.col("cid").alias("cas"), F.col("cluster_id").cast("int")), "cas")
             .select("node", "cluster_id"))
    return nodes.join(label, "node", "left").select(F.col("node").alias(id_col), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
