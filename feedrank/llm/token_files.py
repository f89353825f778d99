"""Token-id files with Elias-Fano document boundaries.

A shard file holds one concatenated id array and, instead of a 64-bit offset
table, its document boundaries ``0 = b_0 <= b_1 <= ... <= b_n`` (the last is the
number of ids) in Elias-Fano form: the low ``l = floor(log2(u / n))`` bits of
each boundary packed side by side, and the high parts in unary, boundary ``i``
setting bit ``(b_i >> l) + i``.  That is about ``2 + log2(u / n)`` bits a
document.  A count of set bits before every 512th bit (the select directory)
finds the word block of the i-th set bit by binary search, so any document's
offset is read without decoding the others.

Layout of a shard file (little-endian)::

    8 bytes   magic b"EFTOK\\x01\\0\\0"
    ids       n_ids items of 2 or 4 bytes
    low       ceil((n_docs + 1) * l / 8) bytes, bit i of the stream = bit (i % 8) of byte i // 8
    high      unary bits, whole 64-byte blocks
    rank      uint32 per 512-bit block of ``high``: set bits before the block
    keys      Arrow IPC stream with one column ``key`` (the document keys, any type)
    footer    JSON: n_docs, n_ids, item, low_bits and the byte offset of each section
    8 bytes   length of the footer

Shards are ranges of the document key, so shard order then file order is key
order; a document's global start is its shard's base (prefix sum of shard
totals, one number a shard) plus its local boundary.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .common import SharedFiles, arrow_schema, col, shared_folder, text_bytes, text_or_empty, to_batch
from .wordbpe import encoder

MAGIC = b"EFTOK\x01\0\0"
BLOCK = 512                                  # bits per select-directory block
SHARD_BYTES = 16 << 20                       # text bytes per shard file (about 7 M ids)
READ_DOCS = 2_048                            # documents decoded at a time when reading back
MANIFEST = "shard int, file string, n_docs long, n_ids long"


class EliasFano:
    """Monotone sequence of non-negative integers; ``select`` returns slices of it."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray, low_bits: int, n: int):
        self.low, self.high, self.rank, self.low_bits, self.n = low, high, rank, low_bits, n

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits)) & 1
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, dtype=np.uint8)
        size = (top >> low_bits) + n + 1
        flags = np.zeros(-(-size // BLOCK) * BLOCK, dtype=np.uint8)
        flags[(values >> low_bits) + np.arange(n)] = 1
        per_block = flags.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")
        return cls(low, np.packbits(flags, bitorder="little"), rank, low_bits, n)

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values ``start .. stop - 1``, touching only the blocks that hold them."""
        stop = min(stop, self.n)
        if stop <= start:
            return np.zeros(0, dtype=np.int64)
        b0 = int(np.searchsorted(self.rank, start, side="right")) - 1
        b1 = int(np.searchsorted(self.rank, stop - 1, side="right"))
        step = BLOCK // 8
        bits = np.unpackbits(self.high[b0 * step:b1 * step], bitorder="little")
        skip = start - int(self.rank[b0])
        ones = np.flatnonzero(bits)[skip:skip + stop - start] + b0 * BLOCK
        high = ones - np.arange(start, stop)
        if not self.low_bits:
            return high
        first = start * self.low_bits
        last = stop * self.low_bits
        raw = np.unpackbits(self.low[first // 8:-(-last // 8)], bitorder="little")
        raw = raw[first % 8:first % 8 + last - first].reshape(-1, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (raw << np.arange(self.low_bits)).sum(axis=1)


def _finish(out, n_ids: int, item: int, lengths: list[int], keys: list, key_type: pa.DataType) -> None:
    """Write the sections behind the ids and the footer."""
    ef = EliasFano.build(np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]))
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([pa.field("key", key_type)])) as w:
        w.write_batch(pa.record_batch([pa.array(keys, type=key_type)], names=["key"]))
    at, meta = len(MAGIC) + n_ids * item, {"n_docs": len(lengths), "n_ids": n_ids, "item": item, "low_bits": ef.low_bits}
    for name, data in (("low", ef.low.tobytes()), ("high", ef.high.tobytes()), ("rank", ef.rank.tobytes()),
                       ("keys", sink.getvalue())):
        meta[name] = [at, len(data)]
        out.write(data)
        at += len(data)
    foot = json.dumps(meta).encode()
    out.write(foot + struct.pack("<Q", len(foot)))


class ShardReader:
    """Random access to the documents of one shard file."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        (n,) = struct.unpack("<Q", self._at(size - 8, 8))
        self.meta = json.loads(self._at(size - 8 - n, n))
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token shard file")
        part = {k: self._at(*self.meta[k]) for k in ("low", "high", "rank", "keys")}
        self.bounds = EliasFano(np.frombuffer(part["low"], np.uint8), np.frombuffer(part["high"], np.uint8),
                                np.frombuffer(part["rank"], "<u4"), self.meta["low_bits"], self.meta["n_docs"] + 1)
        self.keys = pa.ipc.open_stream(part["keys"]).read_all().column("key").combine_chunks()

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def documents(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries and ids (uint32) of documents ``start .. stop - 1``."""
        b = self.bounds.select(start, stop + 1)
        item = self.meta["item"]
        raw = self._at(len(MAGIC) + int(b[0]) * item, int(b[-1] - b[0]) * item)
        return b, np.frombuffer(raw, f"<u{item}").astype("<u4")


def write_token_files(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int | None = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text and write shard files in ascending key order.

    Returns the manifest ``(shard, file, n_docs, n_ids)``, one row per file.
    Rows with equal keys are ordered by text; null keys come first, null texts
    are empty.  One shuffle moves the texts to their key range; ids are never
    shuffled.  An empty table gives no file.
    """
    n = max(1, -(-text_bytes(df, text_col) // shard_bytes))
    docs = df.select(col(id_col).alias("k"), text_or_empty(text_col).alias("t"))
    key_type = arrow_schema(f"k {docs.schema['k'].dataType.simpleString()}").field("k").type
    schema = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        item = enc.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        files, out, name = SharedFiles(folder), None, ""
        lengths: list[int] = []
        keys: list = []
        shard = TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows and out is None:
                name, out = files.create(f"shard-{shard:06d}", ".eftok")
                out.write(MAGIC)
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                coded = enc.encode(part.column("t"))
                for ids in coded:
                    out.write(ids)
                    out.write(end)
                lengths += [(len(ids) + len(end)) // item for ids in coded]
                keys += part.column("k").to_pylist()
        if out is not None:
            n_ids = sum(lengths)
            _finish(out, n_ids, item, lengths, keys, key_type)
            out.close()
            yield to_batch({"shard": [shard], "file": [name], "n_docs": [len(lengths)], "n_ids": [n_ids]}, schema)

    # the text breaks ties of equal keys only
    placed = docs.repartitionByRange(n, "k").sortWithinPartitions("k", "t")
    return cut(placed.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, key_type: str = "long") -> DataFrame:
    """Per document of the files: ``(doc_id, start, n_tokens, ids_crc32)``.

    ``start`` counts the ids of all documents before it over all shards.  The
    driver sees one row per shard file (a count), never a document.
    """
    spark = manifest.sparkSession
    shards = manifest.select("shard", "file", "n_ids").orderBy("shard").collect()
    base, rows = 0, []
    for s in shards:
        rows.append((s["file"], base))
        base += s["n_ids"]
    out = f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with files.open(name) as f:
                    r = ShardReader(f)
                    for at in range(0, r.meta["n_docs"], READ_DOCS):
                        stop = min(at + READ_DOCS, r.meta["n_docs"])
                        bounds, ids = r.documents(at, stop)
                        cuts = (bounds - bounds[0]).tolist()
                        view = memoryview(ids.tobytes())
                        yield to_batch({
                            "doc_id": r.keys.slice(at, stop - at),
                            "start": bounds[:-1] + first,
                            "n_tokens": np.diff(bounds),
                            "ids_crc32": [zlib.crc32(view[4 * x:4 * y]) for x, y in zip(cuts, cuts[1:])],
                        }, schema)

    todo = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return todo.mapInArrow(read, out)


def token_files(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
                folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files, read them back; per document ``(doc_id, start, n_tokens, ids_crc32)``."""
    folder = folder or shared_folder(df.sparkSession, "tokens")
    manifest = write_token_files(df, folder, tokenizer, id_col, text_col, end_id, shard_bytes)
    return read_token_files(manifest, folder, df.schema[id_col].dataType.simpleString())
