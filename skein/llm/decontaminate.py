"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some of the words in a span and ignores the others. The hashes of all masked spans of the benchmark are
joined with those of the documents; around each hit the two word sequences are laid side by side and compared word by
word, so substituted words are tolerated. What is tolerated is ``tolerance``; the masks hit every such stretch, wherever
its substitutions stand (tested over all lengths and placements), so nothing within the tolerance is lost.

The benchmark goes to the tasks in blocks of bounded size; the documents stream past each block and are never shuffled.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.text import doc_of, hash_words, inside, mix, pair, slices, small_batches, texts
from skein.llm.toxicity import CLEAN, words_of

#: Masks for items of ``STRETCH`` words and more, and for shorter ones.
MASKS, SHORT_MASKS = ("11001111", "11101011"), ("1111",)
#: Words of an aligned stretch, and of the shortest item that can be told from chance: items of fewer words match nothing.
STRETCH, SHORTEST = 13, 5
#: Hits that are listed at a time.
HITS = 1 << 21
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 32 << 20
_SLOTS = 20


def seeds(hashes: np.ndarray, mask: str, n: int) -> np.ndarray:
    """Hashes of the masked words of the span that starts at each place."""
    size = len(hashes) - len(mask) + 1
    out = np.full(max(size, 0), n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1" and size > 0:
                out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size]
    return mix(out)


def flatten(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, and where each text starts."""
    return hash_words([x.translate(CLEAN) for x in rows])


def tolerance(words: int) -> tuple[int, int]:
    """Of an item of so many words: the words of an aligned stretch that tells, and the substitutions it may have. Items of ``STRETCH``
    words or more need a stretch of so many, with 2; shorter ones must match in whole, from 8 words on with 1."""
    return (STRETCH, 2) if words >= STRETCH else (words, int(words >= 8))


def stretches(same: np.ndarray, need: int, allowed: int) -> list[tuple[int, int]]:
    """The maximal runs [begin, end) that are covered by windows of ``need`` words of which all but ``allowed`` are the same."""
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(need - (total[need:] - total[:-need]) <= allowed)
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > need) + 1
    return [(int(g[0]), int(g[-1]) + need) for g in np.split(good, cut)]


@dataclass
class Block:
    """Some benchmark items with their seeds, sorted: (mask, seeds, places) of the longer and of the shorter items."""

    ids: list[int | None]
    hashes: np.ndarray
    starts: np.ndarray
    tables: list[tuple[str, np.ndarray, np.ndarray]]
    marks: np.ndarray

    def diagonals(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place in the text less place in the item) where a mask's words agree. Hits are listed in bounded
        pieces, so words that recur thousands of times in both cost time but no memory."""
        doc, item, out = doc_of(starts), doc_of(self.starts), [np.empty((0, 3), np.int64)]
        for n, (mask, keys, places) in enumerate(self.tables):
            if len(h) < len(mask) or not len(keys):
                continue
            s = seeds(h, mask, n)
            at = np.flatnonzero(self.marks[s >> np.uint64(64 - _SLOTS)])
            lo = np.searchsorted(keys, s[at], "left")
            count = np.searchsorted(keys, s[at], "right") - lo
            at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
            ends = np.cumsum(count)
            done = 0
            while done < len(at):
                stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, "right")))
                a, c = at[done:stop], count[done:stop]
                skip = np.repeat(np.cumsum(c) - c, c)
                here, there = np.repeat(a, c), places[np.repeat(lo[done:stop], c) + np.arange(len(skip)) - skip]
                d, i = doc[here], item[there]
                out.append(np.unique(np.stack([d, i, (here - starts[d]) - (there - self.starts[i])], 1), axis=0))
                done = stop
        return np.unique(np.concatenate(out), axis=0) if len(out) > 1 else out[0]

    def leaks(self, rows: list[bytes]) -> list[list[tuple[int | None, int, int, int, int]]]:
        """Of each text: (item id, first word in the text, first word in the item, words, words equal) of every maximal stretch, but
        for those that overlap in the text with one of the same item that has more equal words (of equals the first in the text)."""
        out: list[list] = [[] for _ in rows]
        h, starts = flatten(rows)
        found: dict[tuple[int, int], list] = {}
        for d, i, shift in self.diagonals(h, starts).tolist():
            a, b = h[starts[d] : starts[d + 1]], self.hashes[self.starts[i] : self.starts[i + 1]]
            need, allowed = tolerance(len(b))
            lo, hi = max(0, -shift), min(len(b), len(a) - shift)
            if hi - lo < need:
                continue
            same = a[lo + shift : hi + shift] == b[lo:hi]
            for begin, end in stretches(same, need, allowed):
                found.setdefault((d, i), []).append((-int(same[begin:end].sum()), begin + lo + shift, begin + lo, end - begin))
        for (d, i), every in sorted(found.items()):
            taken: list[tuple[int, int]] = []
            for equal, at, of, n in sorted(every):
                k = bisect(taken, (at, at + n))
                if (k and taken[k - 1][1] > at) or (k < len(taken) and taken[k][0] < at + n):
                    continue
                insort(taken, (at, at + n))
                out[d].append((self.ids[i], at, of, n, -equal))
        return out


def block_of(items: list[tuple[int | None, bytes]]) -> Block:
    """Items of equal words are one, under their least id (no id only if none has one)."""
    first: dict[tuple, int | None] = {}
    for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        words = tuple(words_of(text))
        if len(words) >= SHORTEST:
            first.setdefault(words, i)
    chosen = sorted(first.items(), key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    hashes, starts = flatten([b" ".join(words) for words, _ in chosen])
    size = np.diff(starts)[doc_of(starts)] if len(hashes) else np.empty(0, np.int64)
    marks, tables = np.zeros(1 << _SLOTS, bool), []
    for n, mask in enumerate(MASKS + SHORT_MASKS):
        s = seeds(hashes, mask, n) if len(hashes) >= len(mask) else np.empty(0, np.uint64)
        at = np.flatnonzero(inside(starts, len(mask), len(hashes))) if len(s) else np.empty(0, np.int64)
        at = at[(size[at] >= STRETCH) == (mask in MASKS)]
        order = np.argsort(s[at], kind="stable")
        tables.append((mask, s[at][order], at[order]))
        marks[tables[-1][1] >> np.uint64(64 - _SLOTS)] = True
    return Block([i for _, i in chosen], hashes, starts, tables, marks)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The benchmark in broadcast blocks of about ``block_bytes`` each; one block for all that fits in one. Items of equal words go to
    the same block."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    clean = F.trim(F.translate(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64(clean), F.lit(n)) == k)
        yield items.sparkSession.sparkContext.broadcast(block_of([(r.item_id, r.text.encode()) for r in part.distinct().collect()]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): each maximal stretch that a document shares with a benchmark item, of
    stretches of one item that overlap in the document the one with the most equal words.

    Words are runs of letters and digits, A-Z lower-cased; the tolerance is that of ``tolerance``. Null and short texts hold
    nothing; a null id stays null, also an item's; repeated rows are reported each; items that repeat are reported under
    their least id; an empty benchmark or an empty table finds nothing; other columns play no part.
    """
    rows, out = pair(docs, id_col, text_col), None
    schema = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long"
    for block in blocks(benchmark, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ids = b.column("doc_id").to_pylist()
                found = [(i, *leak) for i, leaks in zip(ids, block.value.leaks(texts(b)), strict=True) for leak in leaks]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, that overlap with no benchmark item; the tolerance and all cases are those of ``find_leaks``."""
    out = docs
    for block in blocks(benchmark, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, by=text_col):
                yield b.filter(pa.array([not x for x in block.value.leaks(texts(b, text_col))], pa.bool_()))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out
