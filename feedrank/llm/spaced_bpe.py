"""Ids of a BPE vocabulary whose pieces never cross white space, a distinct unit at a time.

The tokenizer drops white space, lower-cases and marks word ends, so a text's
ids are those of its units (runs without ASCII white space) one after the other.
Arrow splits a batch and numbers its distinct units (:mod:`.units`); only units a
worker has not met are encoded, plain words by the merge model itself, others by
the library with an added token between them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .units import ENCODERS, UnitTable
from .wordbpe import SIGNS

LINE_UNITS = 1_000              # units encoded by one call


class SpacedEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        normal = [(n.get("type"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = [(p.get("type"), p.get("add_prefix_space"), p.get("behavior")) for p in
               (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if (normal, pre, spec["model"]["type"], bool(spec["model"].get("end_of_word_suffix"))) != (
                [("NFC", None), ("Replace", " "), ("Lowercase", None)],
                [("Split", None, "Removed"), ("ByteLevel", False, None)], "BPE", True):
            raise ValueError("a lower-casing BPE tokenizer with word ends and without white space in pieces is needed")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.mark = spec["added_tokens"][-1]["id"] if self.added else None
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # the library writes bytes as printable characters: those that are not, in order, as 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.tails: dict[str, list[int]] = {}          # ids of runs of signs
        self.table = UnitTable(self.dtype, self._coded)

    def _alone(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def _coded(self, new: list[str]) -> list[list[int]]:
        got: list = [None] * len(new)
        rest = []
        model, tails, alphabet = self.tok.model.tokenize, self.tails, self.alphabet
        for i, unit in enumerate(new):
            word = unit.rstrip(SIGNS)
            if word.isalpha() and (word.isascii() or max(word) < "İ"):     # precomposed letters, simple lower case
                piece = word.lower()
                if not piece.isascii():
                    piece = piece.encode("utf-8").decode("latin-1").translate(alphabet)
                got[i] = ids = [t.id for t in model(piece)]
                if word is not unit:
                    tail = unit[len(word):]
                    if tail not in tails:
                        if len(tails) > LINE_UNITS:
                            tails.clear()
                        tails[tail] = self._alone([tail])[0]
                    ids += tails[tail]
            else:
                rest.append(i)
        apart = self.added[-1] if self.added else None
        for at in range(0, len(rest), LINE_UNITS):
            part = rest[at:at + LINE_UNITS]
            units = [new[i] for i in part]
            if apart and not any(a in u for u in units for a in self.added):
                ids = np.array(self._alone([apart.join(units)])[0], np.int64)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) == len(units) - 1:
                    for i, x in zip(part, np.split(ids, cuts)):
                        got[i] = (x if i == part[0] else x[1:]).tolist()
                    continue
            for i, x in zip(part, self._alone(units)):
                got[i] = x
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)``: the ids of all texts of a string array one after the other, and how many each has."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        count = lists.value_lengths().to_numpy(zero_copy_only=False)
        unit = self.table.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        ids, stop = self.table.join(unit)
        return ids, np.diff(stop[np.concatenate([[0], np.cumsum(count)])])


def spaced_encoder(path: str) -> SpacedEncoder:
    """One encoder per worker process and vocabulary file."""
    if ("spaced", path) not in ENCODERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ENCODERS["spaced", path] = SpacedEncoder(path)
    return ENCODERS["spaced", path]


def word_bpe_path() -> str:
    """The public 49k word vocabulary installed beside Python."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
