"""Arrays as short binary columns: what tasks send each other by the million goes as one row a batch and part."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 (or the bits of doubles), byte plane by byte plane without the planes that are all zero (the shuffle's codec does the rest)."""
    x = values.view(np.uint64) if values.dtype == np.float64 else values.astype(np.uint64, copy=False)
    used = int(np.bitwise_or.reduce(x))
    planes = [k for k in range(8) if used >> 8 * k & 255]
    return np.uint64(len(x)).tobytes() + bytes([sum(1 << k for k in planes)]) + b"".join((x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in planes)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers, as their steps."""
    x = values.astype(np.uint64, copy=False)
    return pack(np.diff(x, prepend=np.uint64(0)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys that ascends, and where each distinct key starts in it. Equal keys are in any order."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)


def ascending(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending (np.unique goes by a hash table, which is slower than a sort of whole numbers)."""
    k = np.sort(keys)
    return k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k


def trim() -> None:
    """Gives the worker's free memory back, which its allocators would keep for later; the heap's only where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Reader:
    """Reads one blob's arrays in the order in which they were joined, from place ``at`` on."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self) -> np.ndarray:
        n = int(np.frombuffer(self.raw, np.uint64, 1, self.at)[0])
        mask = self.raw[self.at + 8]
        self.at += 9
        out = np.zeros((n, 8), np.uint8)
        for k in range(8):
            if mask >> k & 1:
                out[:, k] = np.frombuffer(self.raw, np.uint8, n, self.at)
                self.at += n
        return out.view(np.uint64).ravel()

    def floats(self) -> np.ndarray:
        return self.take().view(np.float64)

    def counts(self) -> np.ndarray:
        return self.take().view(np.int64)

    def take_sorted(self) -> np.ndarray:
        return np.cumsum(self.take(), dtype=np.uint64)


#: A bitmap is gathered in ranges of 1 << RANGE slots.
RANGE = 21


@dataclass
class Bitmap:
    """Whether a slot, the top ``bits`` bits of a 64-bit key, holds a key."""

    bits: int
    words: np.ndarray

    def may(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.words.take((at >> np.uint64(6)).view(np.int64)) >> (at & np.uint64(63)) & np.uint64(1)).view(np.int64) == 1


def bitmaps(frame: DataFrame, keys_of: Callable[[pa.RecordBatch], list[np.ndarray]], n: int, sets: int = 1, most: int = 26) -> list[Bitmap]:
    """Bitmaps of the ``sets`` sets of ``n`` keys or fewer that ``keys_of`` finds in batches, each of 16 slots a key and 1 << ``most``
    slots at most. Each task sends its slots as one row a range, so a range's task and the driver get no more than the bitmaps hold."""
    bits = min(most, max(20, (16 * n).bit_length()))
    ranges = 1 << max(0, bits - RANGE)
    wide = (1 << bits) // ranges

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, keys in enumerate(keys_of(b)):
                at = ascending(keys >> np.uint64(64 - bits))
                edges = np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(wide))
                part = [j for j in range(ranges) if edges[j] < edges[j + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([k * ranges + j for j in part], pa.int32()), pa.array([pack_sorted(at[edges[j] : edges[j + 1]]) for j in part], pa.binary())], ["part", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                held.setdefault(part, np.zeros(wide, bool))[(Reader(blob).take_sorted() - np.uint64(part % ranges * wide)).view(np.int64)] = True
        for part, on in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    found = frame.mapInArrow(slots, "part int, blob binary").repartitionById(sets * ranges, F.col("part")).mapInArrow(merge, "part int, bits binary")
    out = np.zeros((sets, (1 << bits) // 8), np.uint8)
    for r in found.collect():
        k, j = divmod(r.part, ranges)
        out[k, j * wide // 8 : (j + 1) * wide // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return [Bitmap(bits, x.view(np.uint64).copy()) for x in out]


#: Slots of a table that are filled at a time.
_SLOTS = 1 << 16


class Table:
    """Looks up sorted distinct 64-bit keys by their top bits: a slot's keys stand side by side, and there are few to a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(8, (2 * len(keys)).bit_length())
        self.first = np.zeros((1 << self.bits) + 1, np.int32)
        slot, step = (keys >> np.uint64(64 - self.bits)).view(np.int64), min(1 << self.bits, _SLOTS)
        edges = np.searchsorted(slot, np.arange(0, (1 << self.bits) + 1, step))
        for s, a, b in zip(range(0, 1 << self.bits, step), edges[:-1], edges[1:], strict=True):
            self.first[s + 1 : s + step + 1] = a + np.cumsum(np.bincount(slot[a:b] - s, minlength=step))

    def __reduce__(self):  # the slots are told by the keys
        return _table, (pack_sorted(self.keys),)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        slot = (wanted >> np.uint64(64 - self.bits)).view(np.int64)
        place = self.first.take(slot).astype(np.int64)
        stop = self.first.take(slot + 1)
        hit = np.zeros(len(wanted), bool)
        on = np.flatnonzero(place < stop)
        while len(on):
            same = self.keys.take(place[on]) == wanted[on]
            hit[on[same]] = True
            on = on[~same]
            place[on] += 1
            on = on[place[on] < stop[on]]
        return np.where(hit, place, 0), hit


def _table(packed: bytes) -> Table:
    return Table(Reader(packed).take_sorted())


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers a little over a byte: the low bytes, and a bit each for what is above."""
    high = values >> 8
    n = int(high.max(initial=0)).bit_length()
    return pack(values & 255) + bytes([n]) + b"".join(np.packbits(high >> k & 1).tobytes() for k in range(n))


def take_small(r: Reader) -> np.ndarray:
    out = r.counts()
    n, r.at = r.raw[r.at], r.at + 1
    for k in range(n):
        size = (len(out) + 7) // 8
        out |= np.unpackbits(np.frombuffer(r.raw, np.uint8, size, r.at), count=len(out)).astype(np.int64) << 8 + k
        r.at += size
    return out
