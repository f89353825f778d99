"""SentencePiece BPE encoding with seeded merge dropout, and lossless decoding.

A text is read as SentencePiece reads it: a space in front, spaces as U+2581.
Characters that stand side by side in no piece are never merged, so a text is cut
there into units, mostly words with the space before them, encoded one by one.  Each unit's agenda holds the adjacent pairs whose
concatenation is a piece, best score first, leftmost first.  A candidate taken
from the agenda is skipped when the keyed hash of (seed, occurrence, unit, place,
piece) falls below the dropout rate, and merged otherwise; what no piece covers
becomes byte pieces.  Without dropout the ids are the library's own.

An occurrence is a keyed hash of the document and the unit's position, so each
occurrence of a word draws its own merges.  A worker keeps every unit's
undropped encoding with the candidates of its agenda: an occurrence that skips
none of them has that encoding, any other has its agenda run.  Agendas
run for many units at once, one merge of each at a time, in numpy.

Decoding joins the pieces' bytes and drops the first space, for any
segmentation.  A literal U+2581 in a text is written as bytes, so that it is
not read back as a space.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty
from .units import Numbers

SPACE = "\u2581"
LITERAL = "\ud800"           # stands for a U+2581 of the text: no text holds a lone surrogate
RATE = 0.1                   # dropout rate
CACHE_UNITS = 300_000        # units kept by a worker, each with its undropped encoding
CHUNK = 20_000               # units whose agendas run together
WIDE = 48                    # longer units have an agenda of their own
UNKNOWN = 0xFFFF             # symbol of a character that is no piece

_NONE = np.int32(2**31 - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(32))


class DropoutEncoder:
    def __init__(self, path: str, seed: int = 0, rate: float = RATE):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes_id = {bytes([int(pieces[i][3:5], 16)]): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_id) != 256 or n >= UNKNOWN:
            raise ValueError("a merge-type model with byte pieces is needed")
        self.seed, self.limit = seed, int(rate * (1 << 32))
        ids = {pieces[i]: i for i in plain}
        self.of_char = np.full(0x110000, UNKNOWN, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = np.full(n, _NONE, np.int32)
        rank[order] = np.arange(len(order))
        pairs: dict[int, int] = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self.rank = rank
        self._table(pairs)
        # a border between two characters that stand side by side in no piece is never merged over
        side = {ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])}
        self.side = np.array(sorted(side), np.int64)
        self.out = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self._forget()

    # -- agendas ---------------------------------------------------------------

    def _table(self, pairs: dict[int, int]) -> None:
        """Open-addressing table of the pairs: key, rank and piece by slot."""
        self.bits = max(10, (len(pairs) * 4).bit_length())
        size = (1 << self.bits) + 64
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, _NONE, np.int32)
        self.slot_piece = np.zeros(size, np.int32)
        for k in sorted(pairs):
            at = (k * int(_A) & (1 << 64) - 1) >> 64 - self.bits
            while self.slot_key[at] >= 0:
                at += 1
            self.slot_key[at], self.slot_rank[at], self.slot_piece[at] = k, self.rank[pairs[k]], pairs[k]

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair of symbols; slots without a key have rank ``_NONE``."""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = ((key.view(np.uint64) * _A) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slot_key[at]
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            at[open_] += 1
            got = self.slot_key[at[open_]]
            open_ = open_[(got != key[open_]) & (got >= 0)]
        return at

    def _agendas(self, sym: np.ndarray, size: np.ndarray, salt: np.ndarray | None, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Run the agendas of all rows of ``sym`` (symbols, ``UNKNOWN`` where none); without ``salt`` nothing is skipped.

        Returns every row's cells (place << 16 | symbol) and how many are left;
        ``steps`` gets the rows and the coin keys of the candidates taken.
        A cell packs (rank of joining it with the next, place, symbol), so the
        least cell of a row is the next candidate of its agenda.
        """
        m, width = sym.shape
        none = np.int64(_NONE) << np.int64(32)
        low = np.int64(0xFFFF)
        col = np.arange(width)
        last = (size - 1)[:, None] <= col
        rank = np.full((m, width), _NONE, np.int64)
        rank[:, :-1] = self.slot_rank[self._find(sym[:, :-1].ravel(), sym[:, 1:].ravel())].reshape(m, width - 1)
        rank[last] = _NONE
        cell = rank << 32 | col.astype(np.int64) << 16 | sym.astype(np.int64)
        del rank
        out, left = np.zeros((m, width), np.int64), np.zeros(m, np.int64)
        row, size = np.arange(m), size.copy()
        coins = salt is not None and self.limit > 0
        if salt is None:
            salt = np.zeros(m, np.uint64)
        while len(row):
            j = cell.argmin(axis=1)
            best = cell[np.arange(len(row)), j]
            live = best < none
            if not live.all():
                end = ~live
                out[row[end]], left[row[end]] = cell[end], size[end]
                cell, size, row, salt, j, best = (x[live] for x in (cell, size, row, salt, j, best))
                if not len(row):
                    break
            at = np.arange(len(row))
            new = self.slot_piece[self._find(best & low, cell[at, j + 1] & low)].astype(np.int64)
            if steps is not None:
                steps.append((row.copy(), (best >> 16 & low).astype(np.uint64) * _A + (new.astype(np.uint64) << np.uint64(40))))
            if coins:
                coin = _mix(salt + (best >> 16 & low).astype(np.uint64) * _A + (new.astype(np.uint64) << np.uint64(40)))
                drop = (coin >> np.uint64(32)) < np.uint64(self.limit)
                cell[at[drop], j[drop]] |= none
                keep = ~drop
                at, j, new, best = at[keep], j[keep], new[keep], best[keep]
                if not len(at):
                    continue
            # the merged cell takes its place; those behind move up by one
            moved = np.take_along_axis(cell[at] if len(at) < len(row) else cell, np.minimum(col + (col > j[:, None]), width - 1), axis=1)
            here = np.arange(len(at))
            size[at] -= 1
            n = size[at]
            merged = (best & (low << 16)) | new
            nxt = moved[here, np.minimum(j + 1, width - 1)] & low
            rank = np.where(j + 1 < n, self.slot_rank[self._find(new, nxt)], _NONE).astype(np.int64)
            moved[here, j] = rank << 32 | merged
            p = np.flatnonzero(j > 0)
            before = moved[p, j[p] - 1]
            rank = self.slot_rank[self._find(before & low, new[p])].astype(np.int64)
            moved[p, j[p] - 1] = rank << 32 | (before & np.int64(0xFFFFFFFF))
            cell[at] = moved
        return out, left

    def _agenda(self, sym: list[int], salt: int) -> list[tuple[int, int]]:
        """The agenda of one long unit on a heap: ``(place, symbol)`` of what is left."""
        from heapq import heapify, heappop, heappush
        n = len(sym)
        nxt, prev, sym = list(range(1, n + 1)), list(range(-1, n - 1)), list(sym)
        pairs, rank, mask, limit = self.pairs, self.rank, (1 << 64) - 1, self.limit

        def candidate(i: int) -> tuple | None:
            j = nxt[i]
            piece = pairs.get(sym[i] << 20 | sym[j]) if j < n else None
            return None if piece is None else (int(rank[piece]), i, piece, sym[i], sym[j])

        heap = [c for c in map(candidate, range(n)) if c]
        heapify(heap)
        gone = [False] * n
        while heap:
            _, i, piece, a, b = heappop(heap)
            if gone[i] or sym[i] != a or nxt[i] >= n or sym[nxt[i]] != b:
                continue
            if limit:
                h = (salt + i * int(_A) + (piece << 40)) & mask
                h = (h ^ h >> 32) * int(_B) & mask
                h = (h ^ h >> 32) * int(_B) & mask
                if (h ^ h >> 32) >> 32 < limit:
                    continue
            j = nxt[i]
            gone[j], sym[i], nxt[i] = True, piece, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for c in (candidate(i), candidate(prev[i]) if prev[i] >= 0 else None):
                if c:
                    heappush(heap, c)
        return [(i, sym[i]) for i in range(n) if not gone[i]]

    def _salts(self, code: np.ndarray, size: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Keyed hash of every unit (its code points), its occurrence (document and position) and the seed."""
        col = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        h = _mix(code.astype(np.uint64) + col.astype(np.uint64) * _A)
        unit = np.add.reduceat(h, np.cumsum(size) - size)
        return self._salt(unit, occurrence.astype(np.uint64))

    def _salt(self, unit: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        return _mix(unit + occurrence * _B + _mix(np.array([self.seed], np.int64).view(np.uint64)))

    def _ids(self, unit: str, left: list[tuple[int, int]]) -> list[int]:
        """Pieces, and bytes where no piece covers a character."""
        got: list[int] = []
        for place, x in left:
            if x != UNKNOWN:
                got.append(x)
            else:
                got += [self.bytes_id[bytes([b])] for b in (SPACE if unit[place] == LITERAL else unit[place]).encode("utf-8")]
        return got

    def encode_units(self, units: list[str], occurrences: np.ndarray) -> list[list[int]]:
        """Ids of every (unit, occurrence)."""
        out: list = [None] * len(units)
        for at, flat, size in self._runs(units, np.asarray(occurrences).astype(np.uint64)):
            for i, ids in zip(at, np.split(flat, np.cumsum(size)[:-1])):
                out[i] = ids.tolist()
        return out

    def _runs(self, units: list[str], occurrences: np.ndarray | None, traces: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(places in units, their ids in one array, ids of each)``, units of similar length together.

        Without ``occurrences`` nothing is skipped, ``traces`` gets the places in units and the coin
        keys of the candidates taken, and units longer than ``WIDE`` are left out.
        """
        length = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            first = int(length[order[at]])
            top = np.searchsorted(length[order], min(WIDE, first + 3), side="right") if first <= WIDE else at + 1
            part = order[at:min(at + CHUNK, int(top))]
            at += len(part)
            if first > WIDE and occurrences is None:
                continue
            text = [units[i] for i in part]
            code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = length[part]
            salt = None if occurrences is None else self._salts(code, size, occurrences[part])
            if first > WIDE:
                got = np.array(self._ids(text[0], self._agenda(self.of_char[code].tolist(), int(salt[0]))), "<u2")
                yield part, got, np.array([len(got)])
                continue
            row = np.repeat(np.arange(len(part)), size)
            sym = np.full((len(part), max(2, int(size.max()))), UNKNOWN, np.int32)
            sym[row, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)] = self.of_char[code]
            steps: list | None = None if traces is None else []
            cells, left = self._agendas(sym, size, salt, steps)
            if steps:
                traces += [(part[r], key) for r, key in steps]
            used = np.arange(cells.shape[1]) < left[:, None]
            ids = cells & 0xFFFF
            odd = ((ids == UNKNOWN) & used).any(axis=1)
            yield part[~odd], ids[~odd][used[~odd]].astype("<u2"), left[~odd]
            for r in np.flatnonzero(odd):
                got = np.array(self._ids(text[r], [(int(c) >> 16 & 0xFFFF, int(c) & 0xFFFF) for c in cells[r, :left[r]]]), "<u2")
                yield part[[r]], got, np.array([len(got)])

    # -- texts -----------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """A text cut at every border between characters that stand side by side in no piece."""
        if not text:
            return []
        marked = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        key = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.side, key), len(self.side) - 1)
        cut = [0, *(np.flatnonzero(self.side[at] != key) + 1).tolist(), len(marked)]
        return [marked[a:b] for a, b in zip(cut, cut[1:])]

    def _forget(self) -> None:
        self.numbers, self.names = Numbers(), []
        self.flat, self.used = np.zeros(1 << 16, "<u2"), 0
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)                     # of the units' code points
        self.keys = np.zeros(0, np.uint64)                     # coin keys of their undropped agendas, and where each unit's lie
        self.key_begin, self.key_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.wide = np.zeros(0, bool)

    def _keep(self, ids: np.ndarray, used: int) -> None:
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), "<u2")])
        self.flat[used:used + len(ids)] = ids

    def _learn(self) -> None:
        """The undropped encodings of the units noted since the last call, and the coins that must all fall for them."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        self.names += new
        begin, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        traces: list = []
        for at, ids, n in self._runs(new, None, traces):
            self._keep(ids, self.used)
            begin[at] = self.used + np.cumsum(n) - n
            size[at] = n
            self.used += len(ids)
        length = np.fromiter(map(len, new), np.int64, len(new))
        code = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        col = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
        unit = np.add.reduceat(_mix(code.astype(np.uint64) + col.astype(np.uint64) * _A), np.cumsum(length) - length)
        owner = np.concatenate([o for o, _ in traces]) if traces else np.zeros(0, np.int64)
        keys = np.concatenate([k for _, k in traces]) if traces else np.zeros(0, np.uint64)
        key_size = np.bincount(owner, minlength=len(new))
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        self.hash, self.wide = np.concatenate([self.hash, unit]), np.concatenate([self.wide, length > WIDE])
        self.key_begin = np.concatenate([self.key_begin, len(self.keys) + np.cumsum(key_size) - key_size])
        self.key_size = np.concatenate([self.key_size, key_size])
        self.keys = np.concatenate([self.keys, keys[np.argsort(owner, kind="stable")]])

    def _dropped(self, unit: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Places of the occurrences whose agendas skip a candidate, or are run in any case."""
        out = self.wide[unit]
        if self.limit:
            salt = self._salt(self.hash[unit], occurrence)
            n = self.key_size[unit]
            stop = np.cumsum(n)
            key = self.keys[np.repeat(self.key_begin[unit] - stop + n, n) + np.arange(int(stop[-1]) if len(stop) else 0)]
            hit = (_mix(np.repeat(salt, n) + key) >> np.uint64(32)) < np.uint64(self.limit)
            out[np.searchsorted(stop, np.flatnonzero(hit), side="right")] = True
        return np.flatnonzero(out)

    def encode(self, texts: list[str], doc_keys: list) -> list[bytes]:
        """Ids (2 bytes each) of every text; each occurrence of a unit draws its own merges by document key and position."""
        if len(self.numbers) > CACHE_UNITS:
            self._forget()
        split = [self.units(t) for t in texts]
        count = np.array([len(u) for u in split])
        unit = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        base = np.array([int.from_bytes(hashlib.blake2b(f"{self.seed}:{k}".encode("utf-8"), digest_size=8).digest(), "little")
                         for k in doc_keys], np.uint64)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
        occurrence = _mix(place.astype(np.uint64) * _A + np.repeat(base, count))
        self._learn()
        begin, size = self.begin[unit], self.size[unit]
        run = self._dropped(unit, occurrence)
        used = self.used                                       # what follows holds for this call only
        for at, ids, n in self._runs([self.names[i] for i in unit[run].tolist()], occurrence[run]):
            self._keep(ids, used)
            begin[run[at]] = used + np.cumsum(n) - n
            size[run[at]] = n
            used += len(ids)
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(begin - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        cut = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def decode(self, ids: bytes) -> str:
        """The text of any segmentation."""
        got = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8")
        return got[1:] if got[:1] == " " else got



_ENCODERS: dict[tuple, DropoutEncoder] = {}


def encoder(path: str, seed: int, rate: float) -> DropoutEncoder:
    """One encoder per worker process, model, seed and rate."""
    key = (path, seed, rate)
    if key not in _ENCODERS:
        _ENCODERS[key] = DropoutEncoder(path, seed, rate)
    return _ENCODERS[key]


def piece_path() -> str:
    """The public 32k merge-type model installed beside Python."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0,
                     rate: float = RATE) -> DataFrame:
    """``(doc_id, ids)``: each whole text's ids, little-endian 16-bit, as binary.

    Null and empty texts have no ids; equal rows get equal ids; null keys are
    a key of their own; an empty table gives no row.
    """
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("t"))

    def run(cols: dict) -> dict:
        enc = encoder(model, seed, rate)
        ids: list[bytes] = []
        for x in range(0, len(cols["t"]), 500):
            ids += enc.encode(cols["t"][x:x + 500], cols["doc_id"][x:x + 500])
        return {"doc_id": cols["doc_id"], "ids": ids}

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, model: str, seed: int = 0, rate: float = RATE) -> DataFrame:
    """``(doc_id, ids, text)``: every row of ``encode_documents`` decoded."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(cols: dict) -> dict:
        enc = encoder(model, seed, rate)
        return {"doc_id": cols["doc_id"], "ids": cols["ids"], "text": [enc.decode(x) for x in cols["ids"]]}

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, ids binary, text string")


def roundtrip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, rate: float = RATE) -> DataFrame:
    """Encode and decode every text: ``(doc_id, n_ids, ids_crc32, n_chars, text_sha256)``, the last two of the decoded text."""
    enc = encode_documents(df, model, id_col, text_col, seed, rate)
    kind = enc.schema["doc_id"].dataType.simpleString()

    def run(cols: dict) -> dict:
        e = encoder(model, seed, rate)
        texts = [e.decode(x) for x in cols["ids"]]
        return {"doc_id": cols["doc_id"], "n_ids": [len(x) // 2 for x in cols["ids"]],
                "ids_crc32": [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in cols["ids"]],
                "n_chars": [len(t) for t in texts], "text_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]}

    return map_batches(enc, run, f"doc_id {kind}, n_ids long, ids_crc32 long, n_chars long, text_sha256 string")
