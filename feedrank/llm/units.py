"""Token ids of text units, a distinct unit at a time.

A tokenizer that never joins two units encodes a text to the ids of its units
one after the other.  A worker keeps the ids of the units it has met in one
array; a batch's distinct units are looked up (new ones are encoded), and the
batch's ids are gathered by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_UNITS = 500_000           # units kept by a worker; beyond that only those met in two batches stay
BATCH_BYTES = 4 << 20           # text encoded at a time


ENCODERS: dict = {}             # encoders of this worker process by kind and vocabulary file


def forget_encoders() -> None:
    """Free them; workers are used again by operators that do not encode."""
    if ENCODERS:
        ENCODERS.clear()
        pa.default_memory_pool().release_unused()


class Numbers(dict):
    """Unit -> number in order of appearance; new units are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class UnitTable:
    """``code`` gives the id list of each of a list of new units; None marks a unit whose text must be encoded whole."""

    def __init__(self, dtype: np.dtype, code: Callable[[list[str]], list], most: int = CACHE_UNITS):
        self.dtype, self.code, self.most = dtype, code, most
        self.number: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.flat = np.zeros(1 << 16, self.dtype)      # ids of all numbered units, one after the other
        self.end = np.zeros(1 << 14, np.int32)         # where those of each unit end, in bytes
        self.odd = np.zeros(1 << 14, bool)             # units without ids of their own
        self.met = np.zeros(1 << 14, np.uint8)         # batches in which a unit was met (two at most)
        self.used = 0

    def _append(self, k: int, size: np.ndarray, ids: np.ndarray, odd: np.ndarray) -> None:
        n, total = len(size), len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), self.dtype)])
        if k + n + 1 > len(self.end):
            more = max(len(self.end), n + 1)
            self.end = np.concatenate([self.end, np.zeros(more, np.int32)])
            self.odd = np.concatenate([self.odd, np.zeros(more, bool)])
            self.met = np.concatenate([self.met, np.zeros(more, np.uint8)])
        self.flat[self.used:self.used + total] = ids
        self.end[k + 1:k + n + 1] = (self.used + np.cumsum(size)) * self.dtype.itemsize
        self.odd[k:k + n] = odd
        self.used += total

    def _forget(self) -> None:
        """Keep the units met in two batches, or none when those are too many."""
        n = len(self.number)
        keep = np.flatnonzero(self.met[:n] > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        ids, stop = self.join(keep)
        size, odd = np.diff(stop), self.odd[keep]
        names = list(self.number)
        self.number = {names[i]: j for j, i in enumerate(keep.tolist())}
        self._reset()
        self._append(0, size, ids, odd)

    def numbers(self, units: list[str]) -> np.ndarray:
        """Numbers of distinct units, after encoding the new ones; they hold until the next call."""
        if len(self.number) > self.most:
            self._forget()
        number = self.number
        known = np.fromiter(map(number.get, units, repeat(-1)), np.int64, len(units))
        at = np.flatnonzero(known < 0)
        if len(at):
            new = [units[i] for i in at.tolist()]
            got = self.code(new)
            odd = np.zeros(len(new), bool)
            if None in got:
                odd[:] = [x is None for x in got]
                got = [x or () for x in got]
            k = len(number)
            number.update(zip(new, range(k, k + len(new))))
            known[at] = np.arange(k, k + len(new))
            size = np.fromiter(map(len, got), np.int64, len(got))
            self._append(k, size, np.fromiter(chain.from_iterable(got), self.dtype, int(size.sum())), odd)
        met = self.met[known]
        self.met[known] = np.minimum(met + 1, 2)
        return known

    def join(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, stop)``: the units' ids one after the other; the first ``i`` units have ``stop[i]`` ids."""
        table = pa.Array.from_buffers(pa.binary(), len(self.number), [None, pa.py_buffer(self.end), pa.py_buffer(self.flat)])
        taken = table.take(pa.array(unit, pa.int64()))
        data = taken.buffers()[2]
        stop = np.frombuffer(taken.buffers()[1], np.int32)[:len(unit) + 1].astype(np.int64) // self.dtype.itemsize
        ids = np.frombuffer(data, self.dtype, int(stop[-1])) if len(unit) and stop[-1] else np.zeros(0, self.dtype)
        return ids, stop


def byte_slices(texts: pa.Array, most: int = BATCH_BYTES):
    """``(start, stop)`` of slices of about ``most`` bytes (a longer text stands alone)."""
    size = np.maximum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), 1)
    at, total = 0, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, stop
        at = stop
