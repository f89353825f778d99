"""Vector best-fit packing.

A piece of a document is a vector of demands: tokens, one document, and its
attention cost (tokens squared).  A sequence has a capacity for each.  Pieces go,
largest first, to the open sequence of the best score among those that keep
*every* capacity: the least weighted norm of what would be left, or the largest
weighted dot product of demand and what is left; a new sequence opens only when
none fits.

Demands follow from the length alone, so the plan is made for lengths and counts,
not for pieces: sequences with equal residual vectors are one class, and a
placement fills many of them at once (with the norm, the sequence just filled
stays the best one, so it is filled as far as it goes).  The plan's size depends
on the window (at most one row a length, class and range), never on the table,
and one plan covers all pieces, so there is no loss at shard borders and no hot
key: the n-th piece of a length takes the n-th place planned for that length.

Texts are encoded where they are read and never shuffled.  The written pieces
carry their place among the task's pieces of the same length; counts by task and
length give every task its first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..operators.lineage import cut
from .common import arrow_schema, col, text_or_empty, to_batch
from .spaced_bpe import spaced_encoder
from .units import byte_slices

WINDOW = 2_048
NORM, DOT = "norm", "dot"


class Plan:
    """Places by (length, place among the pieces of that length)."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]], sequences: int):
        rows = sorted(rows)
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.first, self.sequence, self.each, self.offset = table.T
        self.sequences = sequences
        self.key = self._key(self.length, self.first)

    @staticmethod
    def _key(length: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (length << 44) | place

    def places(self, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sequence, offset)`` of pieces."""
        row = np.searchsorted(self.key, self._key(length, place), side="right") - 1
        nth = place - self.first[row]
        return self.sequence[row] + nth // self.each[row], self.offset[row] + nth % self.each[row] * length


def best_fit(counts: dict[int, int], window: int = WINDOW, most_documents: int | None = None,
             most_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
             score: str = NORM) -> Plan:
    """Plan for ``counts`` pieces of each length (at most ``window``).

    Unset capacities cannot bind: ``window`` documents, ``window`` squared of
    attention.  Raises if a single piece exceeds a capacity.
    """
    caps = np.array([window, most_documents or window, most_attention or window * window], np.int64)
    scale = np.asarray(weights, float) / caps.astype(float) ** 2
    bound = np.array([True, most_documents is not None, most_attention is not None]) | (scale > 0)
    left = np.zeros((64, 3), np.int64)                  # residuals of the classes of open sequences
    alive = np.zeros(64, bool)
    held: list[list[tuple[int, int]]] = []              # ranges (first sequence, number) of each class
    by_rest: dict[tuple, int] = {}
    used, total = 0, 0
    rows: list[tuple[int, int, int, int, int]] = []
    least = np.array([min(counts, default=1), 1, min(counts, default=1) ** 2], np.int64)

    def add(rest: np.ndarray, first: int, number: int) -> None:
        nonlocal left, alive, used
        if not number or (rest < least).any():          # nothing fits any more
            return
        name = tuple(np.where(bound, rest, 0).tolist())
        k = by_rest.get(name)
        if k is None or not alive[k]:
            if used == len(left):
                left = np.concatenate([left, np.zeros_like(left)])
                alive = np.concatenate([alive, np.zeros_like(alive)])
            k = by_rest[name] = used
            left[k], alive[k] = rest, True
            held.append([])
            used += 1
        else:
            left[k] = np.minimum(left[k], rest)         # capacities that cannot bind
        held[k].append((first, number))

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {caps.tolist()}")
        rest, place = counts[length], 0
        while rest:
            fits = np.flatnonzero(alive[:used] & (left[:used] >= need).all(axis=1))
            if len(fits):
                if score == NORM:
                    value = ((left[fits] - need).astype(float) ** 2 * scale).sum(axis=1)
                else:
                    value = -(left[fits].astype(float) * need * scale).sum(axis=1)
                k = int(fits[np.lexsort((fits, value))[0]])
                residual, ranges = left[k].copy(), held[k]
                alive[k] = False
            else:
                residual, ranges = caps.copy(), []
            each = int((residual // need).min()) if score == NORM or not len(fits) else 1
            if not len(fits):
                number = -(-rest // each)
                ranges = [(total, number)]
                total += number
            kept = []
            for first, number in ranges:
                take = min(number, -(-rest // each))
                if take:
                    done = min(rest, take * each)
                    rows.append((length, place, first, each, int(window - residual[0])))
                    place += done
                    rest -= done
                    full, part = divmod(done, each)
                    add(residual - each * need, first, full)
                    if part:
                        add(residual - part * need, first + full, 1)
                if number > take:
                    kept.append((first + take, number - take))
            for first, number in kept:
                add(residual, first, number)
    return Plan(rows, total)


def _pieces(length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, piece, start, length)`` of documents cut into windows."""
    number = -(-length // window)
    doc = np.repeat(np.arange(len(length)), number)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    start = piece * window
    return doc, piece, start, np.minimum(length[doc] - start, window)


def encode_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int | None = 0, window: int = WINDOW) -> DataFrame:
    """Pieces ``(k, piece, start, length, ids, task, place)``, written; ``ids`` are little-endian 32-bit integers.

    ``place`` counts the pieces of that length before it in the same task.
    """
    docs = df.select(col(id_col).alias("k"), text_or_empty(text_col).alias("t"))
    out = (f"k {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary, "
           "task int, place long")
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = spaced_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        end = np.array([] if end_id is None else [end_id], "<u4")
        for b in batches:
            for a, z in byte_slices(b.column("t")):
                ids, size = enc.encode(b.column("t").slice(a, z - a))
                last = np.cumsum(size)
                flat = np.insert(ids.astype("<u4"), np.repeat(last, len(end)), np.tile(end, len(size)))
                size = size + len(end)
                doc, piece, start, length = _pieces(size, window)
                begin = (np.cumsum(size) - size)[doc] + start
                view = memoryview(flat.tobytes())
                order = np.argsort(length, kind="stable")
                there = length[order]
                new = np.flatnonzero(np.diff(there, prepend=-1))
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(there)) - np.repeat(new, np.diff(np.append(new, len(there)))) + seen[there]
                seen += np.bincount(length, minlength=window + 1)
                yield to_batch({"k": b.column("k").slice(a, z - a).take(pa.array(doc)), "piece": piece, "start": start,
                                "length": length, "ids": [bytes(view[4 * x:4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist())],
                                "task": np.full(len(doc), task, np.int32), "place": place}, schema)

    return cut(docs.mapInArrow(run, out), "packing-pieces")


def vector_pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
                window: int = WINDOW, most_documents: int | None = None, most_attention: int | None = None,
                weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = NORM) -> DataFrame:
    """Pieces of all documents in sequences: ``(id, piece, start, length, ids, sequence_id, offset)``.

    A document is its encoding and ``end_id``; only documents longer than
    ``window`` are cut, into whole windows and a shorter last piece.  Null texts
    are empty (the end id only; without one they have no piece); ids may be null
    or repeated, each row is packed as a document of its own.  An empty table
    gives no piece; extra columns are ignored.
    """
    pieces = encode_pieces(df, tokenizer, id_col, text_col, end_id, window)
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    # at most one row a length
    totals = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(totals, window, most_documents, most_attention, weights, score)
    out = (f"k {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary, "
           "sequence_id long, offset long")
    schema = arrow_schema(out)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                length = b.column("length").to_numpy()
                seq, at = plan.places(length, b.column("place").to_numpy() + b.column("base").to_numpy())
                yield to_batch({**{c: b.column(c) for c in ("k", "piece", "start", "length", "ids")},
                                "sequence_id": seq, "offset": at}, schema)

    placed = lookup_join(pieces, bases.select("task", "length", "base"), ["task", "length"])
    return placed.mapInArrow(place, out).withColumnRenamed("k", id_col)
