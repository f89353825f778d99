"""Web archives with revisit records and a merged capture index.

Writing takes three steps.  The digests of all payloads name, for each one of
at least ``LEAST_BYTES`` bytes, the capture of the smallest id as its response;
the others revisit it.  Each task writes the records of its rows to one archive
file (a gzip member a record) and returns a *run*: the index lines of its file,
sorted by (URL key, timestamp, id).  The runs are then merged: lines go to
ranges of the key, and in each range a loser tree merges the sorted runs k-way,
so that range after range, line after line, the index lists every URL's capture
history in global order.

Reading follows the merged index: each line names file, offset and length of
one record, which is read, unpacked and checked.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .common import SharedFiles, arrow_schema, shared_folder, text_or_empty, to_batch

LEAST_BYTES = 100            # smaller payloads are always stored
MERGE_ROWS = 200_000         # index lines a merge range holds, about
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
LINE = "run string, seq long, url_key string, ts string, id {id}, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, in lower case; no scheme, port or www."""
    u = (url or "").strip().lower()
    head, sep, rest = u.partition("://")
    rest = rest if sep else head
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0]
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + ")" + slash + path.partition("#")[0]


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, the root the overall winner.

    Taking the winner replays only its path: log2(k) comparisons a line.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(self.k, 1)                     # tree[0] is the winner
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Does run ``a`` come before run ``b``?  An ended run comes last; equal lines go by run."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:                                     # first to arrive waits here
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node > 0:
                if self._less(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.tree[0] = i


def record(kind: str, uri: str, date: str, key: str, digest: str, size: int, refers: str | None, payload: bytes) -> bytes:
    """One archive record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:capture:{key}>",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{refers}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode("utf-8")) + c.compress(payload) + c.compress(b"\r\n\r\n") + c.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises if its payload is not what its digest says."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[:int(headers["Content-Length"])]
    if headers["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != headers["WARC-Payload-Digest"]:
        raise ValueError("payload does not match its digest")
    return headers, payload


def _clean(value: str | None) -> str:
    """A header value: no line breaks."""
    return " ".join((value or "").split())


def plan_records(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(id, digest, refers)`` of the revisits: rows whose payload an earlier capture has."""
    payload = text_or_empty(payload_col)
    keys = cut(df.select(F.col(id_col).alias("id"), F.octet_length(payload).alias("size"), F.sha2(payload.cast("binary"), 256).alias("digest"))
               .filter(F.col("size") >= least_bytes).filter(F.col("id").isNotNull()).select("id", "digest"), "digests")
    first = keys.groupBy("digest").agg(F.min("id").alias("refers"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keys.join(first, "digest").filter("id <> refers").select("id", "digest", "refers")


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   ts_col: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write one archive file per task; returns the sorted runs of index lines (``LINE``), written.

    Null payloads are empty; null ids are responses of their own, after the
    others; without ``ts_col`` captures are dated one second apart by id.
    """
    revisit = cut(plan_records(df, id_col, payload_col, least_bytes), "revisits")
    kind = df.schema[id_col].dataType.simpleString()
    ts = F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if ts_col else F.lit(None).cast("string")
    payload = text_or_empty(payload_col)
    src = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), ts.alias("ts"),
                    F.sha2(payload.cast("binary"), 256).alias("digest"))
    # by id and payload: rows that share an id may differ in payload
    joined = src.join(revisit.distinct(), ["id", "digest"], "left")
    line = LINE.format(id=kind)
    schema = arrow_schema(line)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, name, at = SharedFiles(folder), None, "", 0
        lines: list[tuple] = []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name, out = files.create(f"captures-{TaskContext.get().partitionId():06d}", ".warc.gz")
                body = row["payload"].encode("utf-8")
                digest = row["digest"]
                n = row["id"]
                second = n if isinstance(n, int) else zlib.crc32(str(n).encode()) if n is not None else 0
                date = row["ts"] or (EPOCH + timedelta(seconds=second % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                refers = row["refers"]
                member = record("response" if refers is None else "revisit", _clean(row["url"]), date, "" if n is None else str(n), digest,
                                len(body), None if refers is None else str(refers), body if refers is None else b"")
                out.write(member)
                lines.append((url_key(row["url"]), date, (n is None, n if n is not None else 0), name, at, len(member)))
                at += len(member)
        if out is None:
            return
        out.close()
        lines.sort()
        for x in range(0, len(lines), 10_000):
            k, d, i, f, o, m = (list(c) for c in zip(*lines[x:x + 10_000]))
            yield to_batch({"run": f, "seq": list(range(x, x + len(k))), "url_key": k, "ts": d, "id": [None if a else v for a, v in i],
                            "file": f, "offset": o, "length": m}, schema)

    return cut(joined.mapInArrow(write, line), "runs")


def merge_index(runs: DataFrame) -> DataFrame:
    """The runs merged into one global order: ranges in partition order, lines in order within, ``(part, pos, ...)``.

    A range holds about ``MERGE_ROWS`` lines, so the merge's memory does not grow with the index.
    """
    n = max(1, -(-runs.count() // MERGE_ROWS))
    kind = runs.schema["id"].dataType.simpleString()
    out = f"part int, pos long, url_key string, ts string, id {kind}, file string, offset long, length long"
    schema = arrow_schema(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        last = None
        for b in batches:
            c = b.to_pydict()
            for run, key, ts, i, f, o, m in zip(c["run"], c["url_key"], c["ts"], c["id"], c["file"], c["offset"], c["length"]):
                if run != last:
                    held.append([])
                    last = run
                held[-1].append((key, ts, (i is None, i if i is not None else 0), f, o, m))
        part = TaskContext.get().partitionId()
        block: list[tuple] = []
        pos = 0

        def rows() -> pa.RecordBatch:
            k, d, i, f, o, m = (list(x) for x in zip(*block))
            return to_batch({"part": [part] * len(k), "pos": list(range(pos - len(k), pos)), "url_key": k, "ts": d,
                             "id": [None if a else v for a, v in i], "file": f, "offset": o, "length": m}, schema)

        for x in LoserTree([iter(r) for r in held]):
            block.append(x)
            pos += 1
            if len(block) == 10_000:
                yield rows()
                block.clear()
        if block:
            yield rows()

    # a run's lines in a range stay in its own order: seq is their place in the run
    placed = runs.repartitionByRange(n, "url_key", "ts", "id").sortWithinPartitions("run", "seq")
    return cut(placed.mapInArrow(merge, out), "capture-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row per index line, from its record: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, ts, part, pos)``."""
    kind = index.schema["id"].dataType.simpleString()
    out = (f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers string, "
           "url_key string, ts string, part int, pos long")
    schema = arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        open_: dict = {}
        for b in batches:
            c = b.to_pydict()
            got: list[tuple] = []
            for name, offset, length in zip(c["file"], c["offset"], c["length"]):
                if name not in open_:
                    if len(open_) >= 256:
                        open_.pop(next(iter(open_))).close()
                    open_[name] = files.open(name)
                f = open_[name]
                f.seek(offset)
                h, _ = parse(f.read(length))
                refers = h.get("WARC-Refers-To")
                got.append((int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"][len("sha256:"):], h["WARC-Type"],
                            refers and refers[len("<urn:capture:"):-1]))
            if got:
                size, digest, type_, refers = (list(x) for x in zip(*got))
                yield to_batch({"page_id": c["id"], "payload_bytes": size, "payload_digest": digest, "record_type": type_, "refers": refers,
                                "url_key": c["url_key"], "ts": c["ts"], "part": c["part"], "pos": c["pos"]}, schema)

    got = index.mapInArrow(read, out)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"),
                      "url_key", "ts", "part", "pos")


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None,
            least_bytes: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Write archives and their merged index, then read every capture back through the index."""
    folder = folder or shared_folder(df.sparkSession, "warc")
    index = merge_index(write_archives(df, folder, id_col, url_col, payload_col, ts_col, least_bytes))
    return read_archives(index, folder)
