"""Lexical retrieval packing.

Documents are dealt to shards: ranges of ``(group columns, key)``, about
``shard_bytes`` of text each.  A task holds one shard, builds a BM25 inverted
index over its documents (terms are words, rebuilt from the token ids at white
space), and packs it: the first unused document is the seed of a window; the
index returns the seed's best unused neighbours, which fill the window greedily
in score order; the last one is cut at the window's end and its rest seeds the
next window, so only the last window of a shard can have padding.  Whole
windows inside a long document are sequences of their own.  When no unused
neighbour shares a term with the seed, the next unused document follows.

Sharding bounds memory: the index of a task grows with ``shard_bytes``, not
with the corpus, and a hot source is split into many shards by its keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, col, text_bytes, text_or_empty, to_batch
from .wordbpe import encoder

WINDOW = 2_048
SHARD_BYTES = 6 << 20        # text bytes per BM25 shard
QUERY_TERMS = 24             # a seed is queried by its highest-weighted terms
K1, B = 1.2, 0.75            # BM25 parameters
TOP = 32                     # neighbours ranked at first; all are ranked when those do not fill the window
_STEP = np.uint32(0x9E3779B1)
PIECE = ("doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long")


def word_terms(ids: np.ndarray, doc_of: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of every word (ids up to the next white space) and its document."""
    flag = starts[ids]
    flag[first[first < len(ids)]] = True
    at = np.flatnonzero(flag)
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    pos = np.arange(len(ids), dtype=np.int32) - np.repeat(at.astype(np.int32), np.diff(np.append(at, len(ids))))
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * (pos.view(np.uint32) * _STEP + _STEP)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(13)
    return np.add.reduceat(mixed, at), doc_of[at]


class Bm25Index:
    """Inverted index of one shard: postings ``(document, weight)`` by term."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, n: int):
        self.n = n
        bits = np.uint64(32)
        key = np.sort(terms.astype(np.uint64) << bits | docs.astype(np.uint64))    # by term, then document
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(new, len(key)))
        key = key[new]
        self.doc = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        key >>= bits
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df = np.diff(np.append(first, len(key)))
        length = np.bincount(docs, minlength=n)
        norm = K1 * (1 - B + B * length / max(length.mean(), 1e-9))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        term = np.repeat(np.arange(len(df)), df)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.begin = np.concatenate([[0], np.cumsum(df)])
        own = np.flatnonzero(df[term] > 1)                             # a term of one document finds nothing
        # by document, then heaviest first: positive floats order like their bits
        rank = np.uint64(0xFFFFFFFF) - self.weight[own].astype(np.float32).view(np.uint32)
        own = own[np.argsort(self.doc[own].astype(np.uint64) << np.uint64(32) | rank, kind="stable")]
        self.own_term = term[own]                                      # a document's terms, heaviest first
        self.own_begin = np.searchsorted(self.doc[own], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray | None:
        """BM25 of every document for the seed's heaviest terms (None: it shares none)."""
        a = self.own_begin[doc]
        terms = self.own_term[a:min(self.own_begin[doc + 1], a + QUERY_TERMS)]
        if not len(terms):
            return None
        at = np.concatenate([np.arange(self.begin[t], self.begin[t + 1]) for t in terms])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(lengths: np.ndarray, index: Bm25Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard."""
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = 0
    rest = lengths % window
    for d in np.flatnonzero(lengths >= window):
        for k in range(int(lengths[d]) // window):
            pieces.append((int(d), k * window, window, seq, 0))
            seq += 1
    at = lengths - rest                      # where a document's unpacked ids begin
    open_ = rest > 0
    cursor, fill, carried = 0, 0, -1
    n = len(lengths)

    def take(d: int) -> None:
        nonlocal fill, carried
        size = min(int(rest[d]), window - fill)
        pieces.append((d, int(at[d]), size, seq, fill))
        at[d] += size
        rest[d] -= size
        fill += size
        if rest[d]:
            carried = d
        else:
            open_[d] = False

    while True:
        if carried >= 0:
            seed, carried = carried, -1
        else:
            while cursor < n and not open_[cursor]:
                cursor += 1
            if cursor == n:
                break
            seed = cursor
        take(seed)
        if fill < window:
            scores = index.scores(seed)
            if scores is not None:
                scores[~open_] = 0.0
                top = np.argpartition(-scores, TOP)[:TOP] if n > TOP else np.arange(n)
                for cand in (top, None):
                    if cand is None:         # the first did not fill the window: rank them all
                        cand = np.flatnonzero((scores > 0) & open_)
                    for d in cand[np.lexsort((cand, -scores[cand]))]:
                        if fill < window and scores[d] > 0 and open_[d]:
                            take(int(d))
                    if fill == window:
                        break
        if fill == window:
            seq, fill = seq + 1, 0
    return pieces


def retrieval_pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   group_cols: tuple[str, ...] = ("lang", "source"), end_id: int = 1, window: int = WINDOW,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all documents: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    Every id of every document (its encoding, then ``end_id``) lies in exactly
    one piece.  Null texts are empty (the end id only); null group values and
    keys sort first; rows with equal keys are packed as separate documents in
    text order.  An empty table gives no piece.  Missing group columns are skipped.
    """
    groups = [col(c).alias(f"g{i}") for i, c in enumerate(c for c in group_cols if c in df.columns)]
    docs = df.select(*groups, col(id_col).alias("k"), text_or_empty(text_col).alias("t"))
    keys = [c for c in docs.columns if c != "t"]
    n = max(1, -(-text_bytes(docs, "t") // shard_bytes))
    out = PIECE.format(key=df.schema[id_col].dataType.simpleString())
    schema = arrow_schema(out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        coded: list[bytes] = []
        names: list = []
        for b in batches:
            for x in range(0, b.num_rows, 1_000):
                part = b.slice(x, 1_000)
                coded += [ids + end for ids in enc.encode(part.column("t"))]
                names += part.column("k").to_pylist()
        if not coded:
            return
        lengths = np.array([len(x) // enc.dtype.itemsize for x in coded], dtype=np.int64)
        ids = np.frombuffer(b"".join(coded), enc.dtype)
        del coded
        begin = np.concatenate([[0], np.cumsum(lengths)])
        terms, owner = word_terms(ids, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), begin[:-1], enc.word_starts)
        index = Bm25Index(terms, owner, len(lengths))
        pieces = pack_shard(lengths.copy(), index, window)
        base = TaskContext.get().partitionId() << 32
        for x in range(0, len(pieces), 10_000):
            doc, start, size, seq, off = (list(c) for c in zip(*pieces[x:x + 10_000]))
            yield to_batch({
                "doc_id": [names[d] for d in doc], "start": start, "length": size,
                "ids_crc32": [zlib.crc32(ids[begin[d] + s:begin[d] + s + m].astype("<u4").tobytes())
                              for d, s, m in zip(doc, start, size)],
                "doc_tokens": lengths[doc], "sequence_id": [base + s for s in seq], "offset": off}, schema)

    placed = docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "t")
    return placed.mapInArrow(pack, out)
