"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's keys are the 64-bit digests of its paragraphs (lines; a line over
``LONG`` characters is cut after words whose checksum is a multiple of
``CUT_WORDS``, so an edit moves only the cuts beside it), each with its
occurrence number, so repeated paragraphs are different keys.  A sketch has three
rows of ``m`` cells; a key is added to one cell of each row, which keeps a
count, the XOR of its keys and the XOR of their check hashes.

Subtracting two versions' sketches cell by cell cancels what they share.  A
cell left with count 1 or -1 whose check fits its key gives up one differing
key and its side; taking that key out frees other cells, until all are empty
(success) or none is pure.  Then both texts are sketched again with other
positions, and with twice the cells until there are plenty: keys that met in one
try meet by chance only in the next, so some try succeeds.  The likeness is the Jaccard similarity
of the key sets: with ``a`` and ``b`` keys and ``d`` differing ones it is ``s / (s + d)``
where ``s = (a + b - d) / 2``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, col, text_bytes, text_or_empty, to_batch

CELLS = 8                    # cells a row of the smallest sketch
LONG = 120                   # characters; longer lines are cut
CUT_WORDS = 12
SHARD_BYTES = 8 << 20
ROOM = 4                     # cells a row for each key, beyond which only the positions change
SALT = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
FINE = 1 << 20               # cells a row that 20 bits of a hash can name
_C1, _C2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _mix(x: int) -> int:
    x = (x ^ x >> 33) * _C1 & M64
    x = (x ^ x >> 33) * _C2 & M64
    return x ^ x >> 33


def _mix_all(x: np.ndarray) -> np.ndarray:
    s = np.uint64(33)
    x = (x ^ x >> s) * np.uint64(_C1)
    x = (x ^ x >> s) * np.uint64(_C2)
    return x ^ x >> s


def paragraphs(text: str) -> list[str]:
    """Pieces of a text whose concatenation is the text without its line breaks."""
    out: list[str] = []
    for line in text.split("\n"):
        if len(line) <= LONG:
            if line:
                out.append(line)
            continue
        piece: list[str] = []
        for w in line.split(" "):
            piece.append(w)
            if zlib.crc32(w.encode("utf-8")) % CUT_WORDS == 0:
                out.append(" ".join(piece))
                piece = []
        if piece:
            out.append(" ".join(piece))
    return out


def keys(text: str) -> np.ndarray:
    """Distinct 64-bit keys of a text's paragraphs."""
    import xxhash
    seen: dict[str, int] = {}
    digest, nth = [], []
    for p in paragraphs(text):
        k = seen[p] = seen.get(p, 0) + 1
        nth.append(k)
        digest.append(xxhash.xxh3_64_intdigest(p.encode("utf-8")))
    # the occurrence number is mixed in, not given as a seed: short inputs collide over seeds
    return np.unique(_mix_all(np.array(digest, np.uint64) + _mix_all(np.array(nth, np.uint64))))


def _row_all(h: np.ndarray, r: int, m: int) -> np.ndarray:
    """Hashes' cells of row ``r``: by the row's own 20 bits, or by a hash of its own where the rows have more cells."""
    own = (h >> np.uint64(r * 20)) & np.uint64(0xFFFFF) if m <= FINE else _mix_all(h + np.uint64(r + 2))
    return own % np.uint64(m) + np.uint64(r * m)


class Sketch:
    """Three rows of ``m`` cells over a key set; ``turn`` numbers the tries, which place keys differently."""

    __slots__ = ("m", "n", "turn", "count", "key", "check")

    def __init__(self, k: np.ndarray, m: int, turn: int = 0):
        self.m, self.n, self.turn = m, len(k), turn
        h = _mix_all(k + np.uint64(turn * SALT & M64) if turn else k)
        # the check is the low 32 bits of a second hash
        pos = np.concatenate([_row_all(h, r, m) for r in range(3)]).astype(np.int64)
        check = _mix_all(h + np.uint64(1)) & np.uint64(0xFFFFFFFF)
        self.count = np.bincount(pos, minlength=3 * m)
        self.key, self.check = np.zeros(3 * m, np.uint64), np.zeros(3 * m, np.uint64)
        if self.n:
            order = np.argsort(pos, kind="stable")
            at = pos[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self.key[at[first]] = np.bitwise_xor.reduceat(np.tile(k, 3)[order], first)
            self.check[at[first]] = np.bitwise_xor.reduceat(np.tile(check, 3)[order], first)

    def text(self) -> str:
        """The sketch as a string: number of keys, cells a row, then all cells, in base 64."""
        cells = np.empty(3 * self.m, dtype=[("n", "<u2"), ("k", "<u8"), ("c", "<u4")])
        cells["n"], cells["k"], cells["c"] = self.count & 0xFFFF, self.key, self.check
        return base64.b64encode(struct.pack("<II", self.n, self.m) + cells.tobytes()).decode("ascii")


def difference(a: Sketch, b: Sketch) -> tuple[list[int], list[int]] | None:
    """Keys only in ``a`` and only in ``b``, by peeling the subtracted cells (None: it stalls)."""
    m, salt, fine = a.m, a.turn * SALT & M64, a.m <= FINE
    count = (a.count - b.count).tolist()
    key = (a.key ^ b.key).tolist()
    check = (a.check ^ b.check).tolist()
    left: list[int] = []
    right: list[int] = []
    todo = [i for i, c in enumerate(count) if c == 1 or c == -1]
    while todo:
        i = todo.pop()
        c = count[i]
        if c != 1 and c != -1:
            continue
        k = key[i]
        h = _mix(k + salt & M64) if salt else _mix(k)
        v = _mix(h + 1 & M64) & 0xFFFFFFFF
        if check[i] != v:
            continue
        (left if c == 1 else right).append(k)
        for r in range(3):
            j = (h >> r * 20 & 0xFFFFF if fine else _mix(h + r + 2 & M64)) % m + r * m
            count[j] -= c
            key[j] ^= k
            check[j] ^= v
            if count[j] == 1 or count[j] == -1:
                todo.append(j)
    if any(count) or any(key) or any(check):
        return None
    return left, right


def likeness(x: np.ndarray, y: np.ndarray, sx: Sketch, sy: Sketch) -> float:
    """Jaccard similarity of two key sets, from their sketches; others are made while peeling stalls."""
    m, turn = sx.m, 0
    while (found := difference(sx, sy)) is None:
        turn += 1
        if m < ROOM * (CELLS + sx.n + sy.n):
            m *= 2
        sx, sy = Sketch(x, m, turn), Sketch(y, m, turn)
    d = len(found[0]) + len(found[1])
    shared = (sx.n + sy.n - d) // 2
    return shared / (shared + d) if shared + d else 1.0


class _Doc:
    __slots__ = ("id", "text", "keys", "sketch")

    def __init__(self, id_, text: str):
        self.id, self.text = id_, text
        self.keys = keys(text)
        self.sketch = Sketch(self.keys, CELLS)


def _compare(d: _Doc, nxt: _Doc) -> tuple:
    half = len(d.text) // 2
    edited = d.text[:len(d.text) - half] + nxt.text[:half]
    ek = keys(edited)
    es = Sketch(ek, CELLS)
    return (d.id, len(d.text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), d.sketch.text(), es.text(),
            likeness(d.keys, ek, d.sketch, es), likeness(d.keys, nxt.keys, d.sketch, nxt.sketch))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row.

    A document's next one is the one of the next smaller key (rows of equal
    keys in text-hash order, null keys last); the last one's is the first.  Its
    edited text has its last half (rounded down) replaced by as much of the
    next text's beginning.  Null texts are empty; two texts without paragraphs
    have likeness 1; a single row is its own next; an empty table gives no row.

    Keys are dealt to ranges, each in one task in order.  The first row of a
    range is also sent to the range before, where it only serves as the last
    row's next: texts are shuffled once, and nothing is joined.
    """
    n = max(1, -(-text_bytes(df, text_col) // shard_bytes))
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(col(id_col).alias("k"), text_or_empty(text_col).alias("t"))
    ids = src.select("k").filter("k is not null").repartitionByRange(n, F.col("k").desc())
    heads = sorted(r["head"] for r in ids.groupBy(F.spark_partition_id()).agg(F.max("k").alias("head")).collect())   # one a range
    last = max(0, len(heads) - 1)
    placed_schema = arrow_schema(f"part int, carry boolean, k {kind}, t string")
    out = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
    schema = arrow_schema(out)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left
        at = {h: i for i, h in enumerate(reversed(heads))}            # range of which a key is the first
        for b in batches:
            k = b.column("k").to_pylist()
            part = [last if x is None else len(heads) - 1 - bisect_left(heads, x) for x in k]
            carried = [i for i, x in enumerate(k) if (x in at if x is not None else not heads)]
            into = [(at[k[i]] - 1) % len(heads) if heads else 0 for i in carried]
            rows = pa.array([*range(len(k)), *carried])
            yield pa.RecordBatch.from_arrays(
                [pa.array([*part, *into], pa.int32()), pa.array([False] * len(k) + [True] * len(carried)),
                 b.column("k").take(rows), b.column("t").take(rows)], schema=placed_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Doc | None = None
        part = None
        done: list[tuple] = []
        for b in batches:
            for p, carry, k, t in zip(b.column("part").to_pylist(), b.column("carry").to_pylist(), b.column("k").to_pylist(),
                                      b.column("t").to_pylist()):
                if p != part:
                    before, part = None, p
                if carry and before is None:
                    continue
                d = _Doc(k, t)
                if before is not None:
                    done.append(_compare(before, d))
                before = None if carry else d
            if done:
                yield to_batch(dict(zip(schema.names, map(list, zip(*done)))), schema)
                done = []

    placed = src.mapInArrow(place, f"part int, carry boolean, k {kind}, t string").repartition(n, "part")
    ordered = placed.sortWithinPartitions("part", "carry", F.col("k").desc_nulls_last(), F.xxhash64("t"))
    return ordered.mapInArrow(compare, out)
