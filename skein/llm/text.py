"""Words, batches and hashes that the text operators share.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split()`` gives, as UTF-8 never
uses those bytes inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def pair(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own: other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Lets the session's Arrow batches hold so many rows and, but for a longer row, about so many bytes at most: whole texts and
    packed rows are wide, and Arrow's memory lies beside the heap, in every worker twice. Settings of the session, as its
    frames are run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > size:
        spark.conf.set(name, str(size))


def slices(batches: Iterator[pa.RecordBatch], by: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that column ``by`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(by)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, by: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(by).cast(pa.binary()).to_pylist()]


#: Words are hashed in pieces of so many bytes, cut at spaces.
PIECE = 1 << 17
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _spaces(part: np.ndarray) -> np.ndarray:
    return (part == 32) | (part - np.uint8(9) < 5)


class _Powers:
    """The powers of the base and of its inverse, as many as the longest piece needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)]), dtype=np.uint64) for x in (_BASE, _BACK))
        return cls.up, cls.down


def hash_words(rows: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' words in a row, and where each text starts in them (n + 1). ``lower``: A-Z as a-z.

    A word's hash is mixed from its bytes' polynomial, so whole pieces of text are hashed at once from running sums.
    """
    flat = b" ".join([*rows, b""])
    flat = np.frombuffer(flat.translate(_LOWER) if lower else flat, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + 1)
    hashes, at, s = [], [], 0
    while s < len(flat):
        size, last = 0, -1
        while last < 0:  # again only if a word is longer than a piece
            size += PIECE
            part = flat[s : s + size]
            space = _spaces(part)
            last = len(part) - 1 - int(space[::-1].argmax()) if space.any() else -1
        part, space = part[: last + 1], space[: last + 1]
        edge = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1]]))
        begin, end = edge[0::2], edge[1::2]
        if len(begin):
            up, down = _Powers.to(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            digit = part.astype(np.uint64)
            digit += np.uint64(1)
            digit *= up[: len(part)]
            np.cumsum(digit, out=total[1:])
            hashes.append(mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
            at.append(begin + s)
        s += last + 1
    at = np.concatenate(at) if at else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate([[0], np.searchsorted(at, ends)])


_MIX = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finalizer of splitmix64)."""
    if x.ndim and len(x) > _MIX:  # in pieces that stay in the cache
        out = np.empty_like(x)
        for s in range(0, len(x), _MIX):
            out[s : s + _MIX] = mix(x[s : s + _MIX])
        return out
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive 64-bit hashes of the n words that start at each position; the last n - 1 places are absent."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, seed, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size])
    return out


def inside(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each place where n words can start in the row of all words: whether they lie in one text."""
    size = max(total - n + 1, 0)
    ok = np.ones(size, bool)
    if n > 1:
        for s in starts[1:-1]:
            ok[max(s - n + 1, 0) : min(s, size)] = False
    return ok


def doc_of(starts: np.ndarray) -> np.ndarray:
    """The number of the text that each word lies in."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
