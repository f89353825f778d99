"""Byte-level BPE ids through the ``tokenizers`` library, cached per text unit.

The byte-level pre-tokenizer always starts a new piece at a space that does not
lie between two white-space characters, so a text cut at its spaces encodes to
the concatenation of its units' ids, and a batch of texts is put together from
its distinct units (:mod:`.units`).  In new units of letters and signs behind them the pieces are known, so
they go straight to the library's merge model; others are encoded many at a
time as one spaced line, whose ids are dealt back to the units by their byte
lengths (every id of this vocabulary stands for a fixed byte string).  A text
with a unit that is empty or begins with white space, or with an added token
of the vocabulary, is encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .units import ENCODERS, UnitTable, byte_slices

LINE_UNITS = 2_000          # new units encoded in one line
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"     # ASCII punctuation but the apostrophe, which may start a contraction


class Tails(dict):
    """Ids of what follows a piece of letters: a run of signs, or one line feed."""

    def __init__(self, encoder: "UnitEncoder"):
        super().__init__({"": []})
        self.encoder = encoder

    def __missing__(self, tail: str) -> list[int]:
        if len(self) > LINE_UNITS:
            self.clear()
            self[""] = []
        ids = self[tail] = self.encoder._whole([tail])[0].tolist()
        return ids


class UnitEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.width = np.zeros(self.size, dtype=np.int64)       # bytes of each id
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)                 # one character stands for one byte
        self.word_starts = np.zeros(self.size, dtype=bool)     # ids that begin with white space
        for token, i in self.tok.get_vocab().items():
            self.word_starts[i] = token[:1] in "ĠĊĉčĈċČ"
        spec = json.loads(self.tok.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), spec["normalizer"], spec["model"]["type"]) != (
                "ByteLevel", False, True, None, "BPE"):
            raise ValueError("a byte-level BPE tokenizer without prefix space and normalizer is needed")
        # the library writes bytes as printable characters: those that are not, in order, as 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.tails = Tails(self)
        self.table = UnitTable(self.dtype, self._coded)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, lead: str, word: str) -> list[int]:
        """Ids of a piece of letters, by the library's merge model."""
        piece = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tok.model.tokenize(lead + piece)]

    def _coded(self, new: list[str]) -> list:
        """Ids of new units behind a space; None for those that must be encoded with their text."""
        got: list = [None] * len(new)
        rest: list[int] = []
        tails, word_ids = self.tails, self._word
        for i, u in enumerate(new):
            word = u.rstrip(SIGNS)
            if word.isalpha():                         # a piece of letters, then one of signs
                got[i] = ids = word_ids("Ġ", word)
                if word is not u:
                    ids += tails[u[len(word):]]
                continue
            head, feed, tail = u.partition("\n")
            if feed:                                   # two such units in a text's next lines
                a, b = head.rstrip(SIGNS), tail.rstrip(SIGNS)
                if a.isalpha() and b.isalpha():
                    got[i] = [*word_ids("Ġ", a), *tails[head[len(a):]], *tails["\n"], *word_ids("", b), *tails[tail[len(b):]]]
                    continue
            rest.append(i)
        for at in range(0, len(rest), LINE_UNITS):
            self._line(new, rest[at:at + LINE_UNITS], got)
        for i in rest:
            if not new[i] or new[i][0].isspace():
                got[i] = None
        return got

    def _line(self, units: list[str], at: list[int], got: list) -> None:
        """Encode other units as one spaced line and deal its ids back."""
        part = [units[i] for i in at]
        line = " " + " ".join(part)
        # units of different texts may form an added token side by side
        if not any(not u or u[0].isspace() for u in part) and not any(a in line for a in self.added):
            (ids,) = self._whole([line])
            ends = np.cumsum(self.width[ids])
            want = np.cumsum([len(u.encode("utf-8")) + 1 for u in part])
            cut = np.searchsorted(ends, want)
            if np.array_equal(ends[cut], want):
                for i, x in zip(at, np.split(ids, cut[:-1] + 1)):
                    got[i] = x.tolist()
                return
        for i, x in zip(at, self._whole([" " + u for u in part])):
            got[i] = x.tolist()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of every text as bytes of ``dtype``."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        for a, z in byte_slices(texts):
            out += self._batch(texts.slice(a, z - a))
        return out

    def _batch(self, texts: pa.Array) -> list[bytes]:
        # the library cuts at added tokens before anything else
        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if whole.any():
            texts_split = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
        else:
            texts_split = texts
        lists = pc.split_pattern(texts_split, " ")
        flat = lists.flatten()
        count = lists.value_lengths().to_numpy(zero_copy_only=False)
        lead = np.cumsum(count) - count
        # the first unit of a text has no space before it
        first = self._whole(flat.take(pa.array(lead)).to_pylist())
        behind = np.ones(len(flat), bool)
        behind[lead] = False
        coded = flat.filter(pa.array(behind)).dictionary_encode()
        unit = self.table.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        ids, stop = self.table.join(unit)
        cut = stop[np.concatenate([[0], np.cumsum(count - 1)])].tolist()
        out = [f.tobytes() + ids[a:b].tobytes() for f, a, b in zip(first, cut, cut[1:])]
        odd = self.table.odd[unit]
        if odd.any():
            whole[np.repeat(np.arange(len(texts)), count - 1)[odd]] = True
        at = np.flatnonzero(whole)
        if len(at):
            for i, x in zip(at.tolist(), self._whole(texts.take(pa.array(at)).to_pylist())):
                out[i] = x.tobytes()
        return out


def encoder(path: str) -> UnitEncoder:
    """One encoder per worker process and vocabulary file."""
    if ("byte", path) not in ENCODERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ENCODERS["byte", path] = UnitEncoder(path)
    return ENCODERS["byte", path]


def byte_bpe_path() -> str:
    """The public 50k byte-level vocabulary installed beside Python."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
