"""Exact Jaccard join of word-shingle sets by pivots, regions and windows.

Sets ``x`` and ``y`` link when ``100 |x & y| >= P |x | y|``; the Jaccard distance
``d = 1 - |x & y| / |x | y|`` is a metric, so with radius ``e = 1 - P/100`` the
join is a metric range join.  Equal sets form one class; classes are joined.

**First regions.**  Almost all documents are at distance 1 from almost every
other one, so pivots drawn from all documents would leave every document on
every border.  The universe is therefore cut into slices by shingle hash.
Linked sets differ in at most ``k = floor((100-P)/(100+P) (|x|+|y|))`` shingles,
so of ``k + 1`` slices at least one holds the same shingles in both: the slice
content is a pivot at distance 0 within its slice, and the classes with equal
content are its region.  ``k`` follows the size class of the larger set (sizes
between powers of ``100/P``), so a class enters the regions of its own size
class and, as the smaller partner, of the next.  An empty slice says nothing,
so a few more slices are taken: of ``m`` slices ``m - k`` agree, and a set with
fewer empty ones than that needs only its full slices.  The rare others also
enter, for each empty slice, the regions of a second, independent slicing.

**Hubs.**  Near copies meet in many regions, most of them alike.  A region's hub
is its member with most neighbours over all regions (a text that others were
edited from, as a rule); the regions of one hub are taken together, so a pair of
neighbours stands in a few of them at most, and the hub is their first pivot.

**Recursion.**  Each region takes pivots (lowest key hashes), and the distance
from every member to every pivot is computed on sketches: counts of a set's
shingles in hash cells.  The weighted Jaccard distance of the counts is a metric
and never above that of the sets, so windows hold for linked sets, and only pairs
within ``e`` on sketches are compared whole.  Members that link to a pivot are in
one component with it; pivots and what links to them share a label, pairs of one
label are not compared, and regions of one label are done.  Every member belongs to
the Voronoi cell of its nearest pivot, and is replicated to each other cell
whose pivot is at most ``2e`` farther (the triangle inequality puts every
partner of a cell's own members there).  In a cell only pairs with a member
outside the pivot's ball are open, and only within the window
``|d(x,p) - d(y,p)| <= e``; members no such pair needs are dropped, the pivots
leave, and cells that still have open pairs are regions of the next round, with
more pivots.  Regions of at most ``LEAF`` members are finished by a nested loop
over blocks of them: what is within the pivot's window, of like size and of two
labels is compared on sketches, a block pair in a task, and only pairs within
``e`` are rows.  Each round removes its pivots, so the recursion ends with every
linked pair connected: by an edge, or through a pivot that both link to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import by_key, cut, cut_by
from .common import arrow_schema, col, lower_words, map_batches, parts, text_bytes, text_or_empty, to_batch
from .components import components

WORDS_CACHE = 300_000        # word hashes kept by a worker
BUCKET_BYTES = 6 << 20        # text bytes per bucket of slice signatures
FLUSH = 250_000              # signatures a task packs at a time
SIG_BYTES = 5                # of a signature, beside its bucket
SEEN = 1_000_000             # classes a task remembers, to emit a copy's signatures once
LEAST_PERCENT = 75           # below, slices hold about one shingle and say too little
FIRST_PIVOTS, PIVOTS = 1, 32  # pivots of a region in the first round, and in the second (four times more in each later one)
LEAF = 20_000                # members of a region that a nested loop finishes
BLOCK = 512                  # members of a block of that loop
CELLS = 512                  # cells of a sketch
COARSE = 64                  # sums of cells, looked at first
BROADCAST_BYTES = 32 << 20   # sketches or sets of one side of a join that may be broadcast
MAX_ROUNDS = 40              # raises beyond; four-fold pivots outgrow any region long before

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


_WORD_HASH: dict[bytes, int] = {}


def _word_hashes(w: list[bytes]) -> np.ndarray:
    import xxhash
    if len(_WORD_HASH) > WORDS_CACHE:
        _WORD_HASH.clear()
    get, put = _WORD_HASH.get, _WORD_HASH.setdefault
    return np.array([get(x) or put(x, xxhash.xxh3_64_intdigest(x) | 1) for x in w], dtype=np.uint64)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``size`` make one shingle."""
    w = lower_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = _word_hashes(w)
    n = max(1, len(w) - size + 1)
    out = np.full(n, np.uint64(min(len(w), size)))
    for k in range(min(len(w), size)):
        out = _mix(out + h[k:n + k] * _C)
    return np.unique(out)


def set_digest(s: np.ndarray) -> int:
    """Signed 64-bit class key of a set (0 is kept for the empty set)."""
    if not len(s):
        return 0
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


class SliceScheme:
    """Sizes classes and slice counts for one threshold (in percent)."""

    def __init__(self, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"percent must be {LEAST_PERCENT} to 100")
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 40:
            # the next class starts past every size that may link with this class's first
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 100 // percent + 1))
        self.low_array = np.array(self.low)
        self._slices: dict[int, tuple[int, int]] = {}

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.low_array, n, side="right")) - 1

    def slices(self, c: int) -> tuple[int, int]:
        """``(m, k)``: slices used for pairs whose larger set is in class ``c``, and their largest difference.

        ``m - k`` leaves room for the empty slices that the class's smallest sets have by chance.
        """
        if c not in self._slices:
            k = (100 - self.percent) * 2 * (self.low[c + 1] - 1) // (100 + self.percent)
            least = max(1, self.percent * self.low[c] // 100)
            m = k + 1
            while k and m < 2 * k + 2:
                empty = m * math.exp(-least / m)
                if m - k > empty + 3 * math.sqrt(empty):
                    break
                m += 1 + (m - k) // 8
            self._slices[c] = m, k
        return self._slices[c]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Slice signatures of a set, for its own class and as the smaller partner of the next.

        Sets too small to have a linked set other than themselves have none.
        """
        c = self.size_class(len(s))
        out = [self._of(s, k) for k in (c, c + 1) if self.slices(k)[1]]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _contents(self, s: np.ndarray, m: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(s + np.uint64(salt))
        at = (mixed % np.uint64(m)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[first], np.add.reduceat(_mix(mixed[order] + _A), first)

    def _of(self, s: np.ndarray, c: int) -> np.ndarray:
        m, k = self.slices(c)
        full, content = self._contents(s, m, 1)
        base = np.uint64(c * 1_000_003)
        out = _mix(content + _mix((full.astype(np.uint64) << np.uint64(20)) + base))
        if m - len(full) < m - k:              # fewer empty slices than agreeing ones
            return out
        empty = np.setdiff1d(np.arange(m), full).astype(np.uint64)
        second, content = self._contents(s, m, 77)
        inner = _mix(content + (second.astype(np.uint64) << np.uint64(24)))
        if len(second) < m:
            inner = np.append(inner, np.setdiff1d(np.arange(m), second).astype(np.uint64) + _B)
        tag = _mix((empty << np.uint64(20)) + base + _C)
        return np.concatenate([out, _mix(tag[:, None] + inner[None, :]).ravel()])


def members(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(doc_id, text_hash, row_key, n_shingles, node)`` per row; ``node`` is the class key of its set."""
    key = df.schema[id_col].dataType.simpleString()
    src = df.select(col(id_col).alias("doc_id"), _text_hash(text_col).alias("text_hash"), _row_key(id_col, text_col).alias("row_key"),
                    text_or_empty(text_col).alias("t"))

    def run(cols: dict) -> dict:
        sets = [shingle_set(t, size) for t in cols["t"]]
        return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "row_key": cols["row_key"],
                "n_shingles": [len(s) for s in sets], "node": [set_digest(s) for s in sets]}

    return map_batches(src, run, f"doc_id {key}, text_hash long, row_key long, n_shingles long, node long")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def _row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its key and text, so that a class's row is found again without another pass of Python."""
    return F.xxhash64(col(id_col), _text_hash(text_col))


def regions(df: DataFrame, text_col: str, size: int, scheme: SliceScheme) -> DataFrame:
    """``(region, node)``: classes that share a slice signature, where at least two do.

    Signatures travel packed (five bytes each beside their bucket, a class once
    for its run of them) to the bucket of their hash, where one sort finds those
    with several classes; two signatures that agree in bucket and bytes by chance
    make one region of theirs, which costs comparisons and no link.  Copies
    repeat a class's signatures once a task at most.
    """
    buckets = max(1, -(-text_bytes(df, text_col) // BUCKET_BYTES))
    packs = "bucket int, sigs binary, nodes binary, runs binary"
    out = arrow_schema(packs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            sigs.clear()
            nodes.clear()
            at = ((sig >> np.uint64(8 * SIG_BYTES)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, node = at[order], node[order]
            sig = np.ascontiguousarray(sig[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES])
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (node[1:] != node[:-1]), [True]]))
            first, length = node[run[:-1]], np.diff(run).astype("<u4")
            runs = np.searchsorted(run, cuts)                      # a bucket starts a run
            of = lambda x, c: [x[a:z].tobytes() for a, z in zip(c, c[1:])]
            return to_batch({"bucket": at[cuts[:-1]], "sigs": of(sig, cuts), "nodes": of(first, runs), "runs": of(length, runs)}, out)

        held = 0
        for t in (t for b in batches for part in parts(b) for t in part.column("t").to_pylist()):
            s = shingle_set(t, size)
            node = set_digest(s)
            if node in seen or not node:
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(node)
            sig = scheme.signatures(s)
            if len(sig):
                sigs.append(sig)
                nodes.append(np.full(len(sig), node, dtype=np.int64))
                held += len(sig)
            if held > FLUSH:
                yield packed()
                held = 0
        if held:
            yield packed()
        pa.default_memory_pool().release_unused()       # the worker is used again

    found = arrow_schema("region long, node long")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        for b in batches:
            for bucket, sig, node, run in zip(*(b.column(c).to_pylist() for c in out.names)):
                low = np.zeros((len(sig) // SIG_BYTES, 8), np.uint8)
                low[:, :SIG_BYTES] = np.frombuffer(sig, np.uint8).reshape(-1, SIG_BYTES)
                sigs.append(low.view("<i8").ravel() | np.int64(bucket << 8 * SIG_BYTES))
                nodes.append(np.repeat(np.frombuffer(node, np.int64), np.frombuffer(run, "<u4")))
        if not sigs:
            return
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        del sigs, nodes
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        del order
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]                            # a class once a signature
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(first, len(sig)))
        keep = np.repeat(count > 1, count)
        sig, node = sig[keep], node[keep]
        for a in range(0, len(sig), 100_000):
            yield to_batch({"region": sig[a:a + 100_000], "node": node[a:a + 100_000]}, found)
        pa.default_memory_pool().release_unused()

    src = df.select(text_or_empty(text_col).alias("t"))
    return (src.mapInArrow(emit, packs).repartition(buckets, "bucket")
            .mapInArrow(match, "region long, node long"))


def _distinct_regions(r: DataFrame) -> DataFrame:
    """Keep one of the regions with the same members in the same roles."""
    h = F.xxhash64("node", "host")
    mark = (r.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 34)).alias("a"), F.bit_xor(h).alias("b"))
            .groupBy("n", "a", "b").agg(F.min("region").alias("region")).select("region"))
    return r.join(mark, "region", "left_semi")


def _around_hubs(r: DataFrame) -> DataFrame:
    """``(region, node)``: all members of the regions with one hub, under the hub's key."""
    size = r.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    degree = r.join(size, "region").groupBy("node").agg(F.sum("n").alias("degree"))
    best = F.max(F.struct("degree", F.xxhash64("node").alias("h"), "node"))
    hub = r.join(degree, "node").groupBy("region").agg(best.alias("best")).select("region", F.col("best.node").alias("hub"))
    return r.join(hub, "region").select(F.col("hub").alias("region"), "node").distinct()


def link_classes(region: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int,
                 first_pivots: int = FIRST_PIVOTS, pivots: int = PIVOTS, leaf: int = LEAF) -> DataFrame:
    """Edges ``(src, dst)`` that connect exactly the components of the linked classes.

    ``region (region, node)``: every linked pair shares one; ``sets (node, s, bytes)``:
    each node's shingles; ``sketches (node, s, bytes)``: their cell counts.  Both are
    read by ``node`` in every round, so they are best in buckets of it.
    """
    eps = 1.0 - percent / 100.0
    slack = 1e-9                                   # windows are widened by rounding; links are tested on integers
    state = cut(_distinct_regions(region.select("region", "node", F.lit(True).alias("host"))), "regions")
    state = cut(_around_hubs(state).withColumn("host", F.lit(True)), "regions")
    edges: DataFrame | None = None
    labels: DataFrame | None = None                # (node, label) of nodes with links: equal labels are connected
    for round_ in range(MAX_ROUNDS):
        if state.limit(1).count() == 0:
            break
        k = first_pivots if round_ == 0 else pivots * 4 ** (round_ - 1)
        # pivots: the hosts of lowest hash; the group limit runs before the shuffle, so a hot region sends k rows a task
        # those of a label that is rare in the region come first: when they leave, what is left is connected
        # the hub, whose key names the region, is the first pivot of the first round
        hosts = state.filter("host").select("region", "node")
        if round_ == 0:
            hosts = hosts.withColumn("same", (F.col("node") != F.col("region")).cast("int"))
        elif labels is not None:
            hosts = hosts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            hosts = hosts.join(hosts.groupBy("region", "label").agg(F.count(F.lit(1)).alias("same")), ["region", "label"])
        else:
            hosts = hosts.withColumn("same", F.lit(1))
        rank = F.row_number().over(Window.partitionBy("region").orderBy("same", F.xxhash64("node"), "node"))
        chosen = cut(hosts.withColumn("r", rank).filter(F.col("r") <= k)
                     .select("region", F.col("node").alias("pivot"), F.col("r").alias("cell")), "pivots")
        pairs = state.join(chosen, "region").filter("node <> pivot")
        wanted = pairs.select("node", "pivot").distinct()
        measured = cut(_distances(wanted, sketches), "distances")
        # linked sets are within eps of one another in the sketches too; only those pairs are looked at whole
        near = measured.filter(F.col("d") <= eps + slack).select("node", "pivot")
        known = None
        if labels is not None:                     # connected already: nothing to look at
            of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
            near = near.join(of("node"), "node", "left").join(of("pivot"), "pivot", "left")
            near = cut(near.select("node", "pivot", F.coalesce(F.col("node_label") == F.col("pivot_label"), F.lit(False)).alias("known")), "near")
            known, near = near.filter("known").select("node", "pivot"), near.filter("not known").select("node", "pivot")
        hit = cut(_linked(near, sets, percent), "links")
        new = hit.select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
        if labels is None:                         # most links are those to hubs; their components are labels
            labels = cut(components(new), "labels")
            new = labels.select(F.col("node").alias("src"), F.col("label").alias("dst"))
        else:
            labels = cut(_labelled(hit, labels), "labels")
        edges = new if edges is None else edges.unionByName(new)
        joined = hit if known is None else hit.unionByName(known)
        measured = measured.join(joined.withColumn("linked", F.lit(True)), ["node", "pivot"], "left").withColumn(
            "linked", F.coalesce("linked", F.lit(False)))
        # Voronoi cells: home at the nearest pivot, guests where the window of 2e reaches
        far = pairs.join(measured, ["node", "pivot"])
        if k > 1:
            best = F.min(F.struct("d", "cell")).over(Window.partitionBy("region", "node"))
            own = chosen.select("region", F.col("pivot").alias("node"), F.lit(True).alias("is_pivot"))
            far = (far.join(own, ["region", "node"], "left").filter("is_pivot is null")
                   .withColumn("best", best).filter(F.col("d") <= F.col("best.d") + 2 * eps + slack)
                   .withColumn("host", F.col("host") & (F.col("cell") == F.col("best.cell"))))
        cell = F.when(F.lit(k == 1), F.col("region")).otherwise(F.xxhash64("region", "cell"))
        far = far.select(cell.alias("region"), "node", "host", "d", "linked")
        far = cut(far, "cells")
        # open pairs: a host with a member, at least one of the two outside the pivot's ball, within the window
        out = far.filter("not linked").groupBy("region").agg(
            F.min("d").alias("near_out"), F.min(F.when(F.col("host"), F.col("d"))).alias("near_out_host"))
        host_in = far.filter("linked and host").groupBy("region").agg(F.max("d").alias("far_in_host"))
        reach = F.when(F.col("host"), F.col("near_out")).otherwise(F.col("near_out_host"))
        nxt = (far.join(out, "region").join(host_in, "region", "left")
               .filter((~F.col("linked") & (F.col("host") | F.col("near_out_host").isNotNull()
                                            | (F.col("d") <= F.col("far_in_host") + eps + slack)))
                       | (F.col("linked") & (reach <= F.col("d") + eps + slack)))
               .select("region", "node", "host", "d"))
        # a region of one label is connected
        nxt = nxt.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        live = nxt.groupBy("region").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.max("host").alias("h")).filter("a <> z and h")
        state = cut(_distinct_regions(nxt.join(live.select("region"), "region", "left_semi")), "regions")
        size = cut(state.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "sizes")
        near = _near_in_blocks(state.join(size.filter(F.col("n") <= leaf), "region"), sketches, eps + slack)
        hit = cut(_linked(cut(near.distinct(), "near"), sets, percent), "links")
        edges = edges.unionByName(hit.select(F.col("node").alias("src"), F.col("pivot").alias("dst")))
        large = size.filter(F.col("n") > leaf)
        if large.limit(1).count() == 0:
            break
        state = cut(state.join(large, "region", "left_semi").select("region", "node", "host"), "regions")
    else:
        raise RuntimeError(f"regions were still open after {MAX_ROUNDS} rounds")
    if edges is None:
        edges = region.sparkSession.createDataFrame([], "src long, dst long")
    return edges


def _labelled(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(node, label)`` after new links ``(node, pivot)``: a pivot and all that link to it take their least label."""
    if labels is None:
        star = links.select("pivot", F.col("node").alias("label")).unionByName(links.select("pivot", F.col("pivot").alias("label")))
    else:
        both = links.select("pivot", "node").unionByName(links.select("pivot", F.col("pivot").alias("node")).distinct())
        star = both.join(labels, "node", "left").select("pivot", F.coalesce("label", "node").alias("label"))
    least = star.groupBy("pivot").agg(F.min("label").alias("label"))
    new = links.join(least, "pivot").select("node", "label").unionByName(least.select(F.col("pivot").alias("node"), "label"))
    return (new if labels is None else new.unionByName(labels)).groupBy("node").agg(F.min("label").alias("label"))


def sketch(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of ``CELLS`` cells (bytes; two bytes a cell for very large sets)."""
    counts = np.bincount((_mix(s + _C) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u2").tobytes()


def _cells(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == CELLS else "<u2").astype(np.int32)


def _beside(pairs: DataFrame, wide: DataFrame, key: str, new: str) -> DataFrame:
    """``pairs`` with the column ``s`` of ``wide (node, s, bytes)`` as ``new``; ``wide`` is broadcast only where what
    is wanted of it is proven to be small (by ``bytes``, so that no ``s`` is read for it).  Else rows of ``wide``
    are hashed or stream by, and are not sorted: keys are the hash side, or what they want where ``pairs`` are wide too."""
    keys = pairs.select(F.col(key).alias("node")).distinct()
    small = (wide.select("node", "bytes").join(keys, "node", "left_semi").agg(F.sum("bytes")).first()[0] or 0) <= BROADCAST_BYTES
    side = wide.select(F.col("node").alias(key), F.col("s").alias(new))
    if small:
        return pairs.join(F.broadcast(side.join(pairs.select(key).distinct(), key, "left_semi")), key)
    if pairs.columns == ["node", "pivot"]:
        return pairs.hint("shuffle_hash").join(side, key)
    return pairs.join(side.join(keys.withColumnRenamed("node", key).hint("shuffle_hash"), key, "left_semi").hint("shuffle_hash"), key)


def _distances(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(node, pivot, d)``: weighted Jaccard distance of the cell counts, a metric that is never above the sets' distance."""
    both = _beside(_beside(pairs, sketches, "pivot", "sy"), sketches, "node", "sx")
    schema = arrow_schema("node long, pivot long, d double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                d = []
                for x, y in zip(part.column("sx").to_pylist(), part.column("sy").to_pylist()):
                    x, y = _cells(x), _cells(y)
                    common = int(np.minimum(x, y).sum())
                    d.append(1 - common / (int(x.sum()) + int(y.sum()) - common))
                yield to_batch({"node": part.column("node"), "pivot": part.column("pivot"), "d": d}, schema)

    return both.select("node", "pivot", "sx", "sy").mapInArrow(run, "node long, pivot long, d double")


def _near_in_blocks(state: DataFrame, sketches: DataFrame, eps: float) -> DataFrame:
    """Pairs ``(node, pivot)`` of one region and two labels within ``eps`` on sketches, at least one of them a host.

    ``state (region, node, host, d, label, n)``: ``d`` is the distance to the region's pivot, ``n`` its
    members.  A region is cut into blocks by hash, and a block pair is one row of its members.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = state.withColumn("b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.join(sketches.drop("bytes"), "node").withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    packed = rows.groupBy("region", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).agg(
        F.collect_list(F.struct("node", "host", "d", "label", "b", "s")).alias("m")).filter("size(m) > 1").select("m")
    schema = arrow_schema("node long, pivot long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for b in batches for part in parts(b)):
            lists = part.column("m")
            stop = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            node, host, d, label, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "host", "d", "label", "b"))
            found = [(node[a:z][x], node[a:z][y]) for a, z in zip(np.append(0, stop[:-1]).tolist(), stop.tolist()) for x, y in
                     [_near(flat.field("s")[a:z].to_pylist(), host[a:z], d[a:z], label[a:z], b[a:z], eps)] if len(x)]
            if found:
                x, y = (np.concatenate(c) for c in zip(*found))
                yield to_batch({"node": np.minimum(x, y), "pivot": np.maximum(x, y)}, schema)
        pa.default_memory_pool().release_unused()       # the worker is used again

    return packed.mapInArrow(run, "node long, pivot long")


def _near(data: list[bytes], host: np.ndarray, d: np.ndarray, label: np.ndarray, block: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(x, y)`` of the pairs of a block pair (of a block, if there is one) that are within ``eps`` on sketches."""
    wide = max(map(len, data)) > CELLS
    cells = np.stack([np.frombuffer(s, np.uint8 if len(s) == CELLS else "<u2").astype("<u2" if wide else np.uint8, copy=False) for s in data])
    total = cells.sum(axis=1, dtype=np.int64)
    order = np.argsort(total, kind="stable")
    cells, total, host, d, label, block = cells[order], total[order], host[order], d[order], label[order], block[order]
    coarse = cells.reshape(len(cells), COARSE, -1).sum(axis=2, dtype=np.int32 if wide else np.uint16)
    across = block.min() != block.max()
    last = np.searchsorted(total, total / (1 - eps), side="right")      # a larger partner cannot be near
    xs, ys = [], []
    for i in range(len(cells) - 1):
        j = slice(i + 1, last[i])
        fit = (label[j] != label[i]) & (np.abs(d[j] - d[i]) <= eps)
        if not host[i]:
            fit &= host[j]
        if across:
            fit &= block[j] != block[i]
        at = np.flatnonzero(fit) + i + 1
        for grid in (coarse, cells):                   # sums of cells can only be more alike
            if len(at):
                common = np.minimum(grid[at], grid[i]).sum(axis=1, dtype=np.int64)
                at = at[1 - common / (total[at] + total[i] - common) <= eps]
        if len(at):
            xs.append(np.full(len(at), i))
            ys.append(at)
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(xs)], order[np.concatenate(ys)]


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(node, pivot)`` that link, decided on the whole sets."""
    both = _beside(_beside(pairs, sets, "node", "sx"), sets, "pivot", "sy")
    inter = F.size(F.array_intersect("sx", "sy"))
    got = both.select("node", "pivot", inter.alias("i"), (F.size("sx") + F.size("sy")).alias("n"))
    return got.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("node", "pivot")


def _grouped(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, first_pivots: int, pivots: int,
             leaf: int = LEAF) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, digest, label, component_id)`` per row; ``label`` is its component's smallest node."""
    src = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    member = cut(members(src, "doc_id", "text", size), "members")
    # a class is found again by the row of its smallest key, and is a node under that row's name from here on
    rep = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"), F.col("row_key"))).alias("m")
    classes = cut(member.filter("n_shingles > 0").groupBy(F.col("node").alias("digest")).agg(rep)
                  .select("digest", F.col("m.doc_id").alias("rep"), F.col("m.row_key").alias("node")), "classes")
    found = regions(src, "text", size, SliceScheme(percent)).withColumnRenamed("node", "digest")
    region = cut(found.join(classes.select("digest", "node"), "digest").select("region", "node"), "regions")

    def sets_of(cols: dict) -> dict:
        got = [shingle_set(t, size) for t in cols["t"]]
        of = [sketch(s) for s in got]
        return {"node": cols["node"], "s": [s.view(np.int64) for s in got], "k": of,
                "s_bytes": [s.nbytes for s in got], "k_bytes": [len(k) for k in of]}

    # texts move once, to the buckets in which their sets are written; rows equal in key and text are one
    texts = by_key(src.select(_row_key("doc_id", "text").alias("node"), text_or_empty("text").alias("t")), "node")
    texts = texts.join(region.select("node").distinct().hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])
    sets = cut_by(map_batches(texts, sets_of, "node long, s array<long>, k binary, s_bytes long, k_bytes long"), "node", "sets")
    sketches = sets.select("node", F.col("k").alias("s"), F.col("k_bytes").alias("bytes"))
    sets = sets.select("node", "s", F.col("s_bytes").alias("bytes"))
    label = components(link_classes(region, sets, sketches, percent, first_pivots, pivots, leaf))
    named = classes.join(label, "node").select("digest", "rep", "label")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    # only classes with links can have another id than their own representative
    linked = named.join(least, "label").select("digest", "label", "component_id")
    alone = classes.join(linked.select("digest"), "digest", "left_anti").select(
        "digest", F.col("node").alias("label"), F.col("rep").alias("component_id"))
    return (member.withColumnRenamed("node", "digest").join(linked.unionByName(alone), "digest", "left")
            .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90,
                       first_pivots: int = FIRST_PIVOTS, pivots: int = PIVOTS, leaf: int = LEAF) -> DataFrame:
    """Per row ``(doc_id, n_shingles, component_id)``.

    ``component_id`` is the smallest key reachable by links, the row's own
    included.  Null and empty texts have no shingle and are linked with
    nothing; equal rows are one class; a null key is a component's id only
    where every key of it is null; an empty table gives no row.
    """
    return _grouped(df, id_col, text_col, size, percent, first_pivots, pivots, leaf).select("doc_id", "n_shingles", "component_id")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                         percent: int = 80) -> DataFrame:
    """One document of each near-duplicate group (that of the smallest key), with all its columns.

    Documents without words are kept.  Where a key is repeated, the row with
    the smallest text hash stays for its group; rows equal in key and text are
    reduced to one, the same in every run.  Null and empty texts are documents
    without words; an empty table gives no row; columns may have any names.
    """
    found = _grouped(df, id_col, text_col, size, percent, FIRST_PIVOTS, PIVOTS)
    empty = found.filter("n_shingles = 0").select("doc_id", "text_hash")
    first = (found.filter("n_shingles > 0").groupBy("label")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("m"))
             .select("m.doc_id", "m.text_hash"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows")).select(
        F.col("doc_id").alias("_row_id"), F.col("text_hash").alias("_row_hash"), "_rows")
    keep = empty.unionByName(first).distinct().join(
        rows, F.col("doc_id").eqNullSafe(F.col("_row_id")) & (F.col("text_hash") == F.col("_row_hash")))
    keep = cut(keep.select(F.col("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash"), "_rows"), "keep")
    places = [f"_c{i}" for i in range(len(df.columns))]
    row = df.select(col(id_col).alias("_id"), _text_hash(text_col).alias("_hash"), F.struct(*[col(c).alias(p) for c, p in zip(df.columns, places)]).alias("doc"))
    same = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_hash") == F.col("_keep_hash"))
    one = row.join(keep.filter("_rows = 1").hint("shuffle_hash"), same, "left_semi").select("doc")     # texts stream by
    # only rows equal in key and text are grouped
    many = row.join(keep.filter("_rows > 1"), same, "left_semi").groupBy("_id", "_hash").agg(
        F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc")
    return one.unionByName(many).select("doc.*").toDF(*df.columns)
