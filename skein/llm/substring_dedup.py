"""Substring dedup: passages of ``WINDOW`` words or more that also stand in a document with a smaller id.

Documents are cut in overlapping segments, each the longest run of windows that share a minimizer (the least hash of the
``GRAM``-word grams in a window). Equal windows have equal minimizers, so if segments are dealt to shards by minimizer,
every window meets all its equals in one shard, and a shard needs no other shard. Each shard has a compressed FM-index
of its distinct segments, each owned by its least document. The segments stream past it: backward search over the wavelet
matrix gives the matching statistic at each place, up to the window's length, and the range of all occurrences; where
the whole window is found and the least owner in its range is smaller than the document, the interval is reported.

What moves is kept small:
- minimizers that only one document holds are left out: their hashes alone are counted first, and each document is told
  which of its segments others share. A bitmap of bounded size spares most hashes that way (one that is full spares none);
- a batch sends each shard one row, with equal segments once;
- windows under a minimizer that very many segments share are dealt one by one, by their own hash, with their least
  and greatest document only; the shard's finding goes back to the documents as a table by window, so that no task gets a
  group of places that grows with the corpus. There are at most ``HOT_SHARE`` such minimizers;
- texts without a finding never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.durable import release, stored
from skein.llm.fm_index import FMIndex
from skein.llm.packing import Reader, distinct, pack, pack_sorted
from skein.llm.text import grams, hash_words, inside, mix, slices, texts

WINDOW, GRAM = 13, 6
#: log2 of the bitmap's slots: 8 MB; it is gathered in so many ranges.
SLOTS, RANGES = 26, 16
#: A minimizer is hot above so many occurrences, and above this part of all occurrences.
HOT, HOT_SHARE = 1000, 50_000
#: Words of segments that a shard gets on average, and minimizers that a part of their count gets.
SHARD_WORDS, PART = 2_000_000, 2_000_000
#: Findings on hot windows that are broadcast at most; beyond it they are joined.
BROADCAST = 1_000_000
#: Bytes of a word's hash that segments carry.
WORD_BYTES = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64((1 << 8 * WORD_BYTES) - 1)
_BATCH = 8 << 20
_ID = np.uint64(1 << 63)


def minimizers(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: their first window, their number of windows, and the minimizer's hash."""
    size = len(hashes) - window + 1
    none = np.empty(0, np.int64)
    if size <= 0:
        return none, none, np.empty(0, np.uint64)
    g = grams(hashes, GRAM)
    best, at = g[:size].copy(), np.arange(size)
    for k in range(1, window - GRAM + 1):
        other = g[k : k + size]
        less = np.flatnonzero(other < best)
        best[less] = other[less]
        at[less] = less + k
    whole = np.flatnonzero(inside(starts, window, len(hashes)))
    if not len(whole):
        return none, none, np.empty(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (at[whole][1:] != at[whole][:-1]) | (np.diff(whole) != 1)]))
    first = whole[new]
    return first, np.diff(np.append(new, len(whole))), best[first]


def _slot(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(64 - SLOTS)


def _shared(rows: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A bitmap of the slots whose minimizers two rows hold, the hot slots, sorted; and the occurrences in all shared slots."""
    wide = 1 << (SLOTS - RANGES.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            h, starts = hash_words(texts(b))
            first, _, anchor = minimizers(h, starts, window)
            if not len(first):
                continue
            doc = np.searchsorted(starts, first, "right") - 1
            slot = _slot(anchor)
            order = np.argsort(slot, kind="stable")  # documents stay in order within a slot
            slot, doc = slot[order], doc[order]
            cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            end = np.append(cut[1:], len(slot))
            two = doc[cut] != doc[end - 1]
            slot = slot[cut]
            edges = np.searchsorted(slot, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64(wide))
            part = [k for k in range(RANGES) if edges[k] < edges[k + 1]]
            blobs = [pack_sorted(slot[edges[k] : edges[k + 1]]) + pack((2 * (end - cut) + two)[edges[k] : edges[k + 1]]) for k in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows_of = {}, {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if part not in n:
                    n[part], rows_of[part] = np.zeros(wide, np.int64), np.zeros(wide, np.uint8)
                r = Reader(blob)
                at, told = (r.take_sorted() - np.uint64(part * wide)).astype(np.int64), r.take().astype(np.int64)
                n[part][at] += told >> 1
                rows_of[part][at] = np.minimum(rows_of[part][at] + 1 + (told & 1), 2)
        for part in n:
            shared = rows_of[part] > 1
            many = np.flatnonzero(shared & (n[part] > HOT))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.packbits(shared).tobytes()], pa.binary()), pa.array([int(n[part][shared].sum())]), pa.array([(many + part * wide).tolist()], pa.list_(pa.int64())), pa.array([n[part][many].tolist()], pa.list_(pa.int64()))],
                ["part", "bits", "total", "slots", "counts"],
            )

    counted = rows.mapInArrow(count, "part int, blob binary").repartitionById(RANGES, F.col("part"))
    found = stored(counted.mapInArrow(merge, "part int, bits binary, total long, slots array<long>, counts array<long>"), "slots")
    total = found.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bitmap = np.zeros(1 << (SLOTS - 3), np.uint8)
    for r in found.select("part", "bits").collect():
        bitmap[r.part * wide // 8 : (r.part + 1) * wide // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    hot = found.select(F.inline(F.arrays_zip("slots", "counts"))).filter(F.col("counts") > max(HOT, total // HOT_SHARE)).select("slots").collect()
    release(found)
    return bitmap, np.sort(np.array([r.slots for r in hot], np.uint64)), total


def _told(anchor: np.ndarray, bitmap: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether two documents may hold each minimizer; and whether it is hot."""
    slot = _slot(anchor).astype(np.int64)
    keep = (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
    slot = slot.astype(np.uint64)
    is_hot = hot[np.minimum(np.searchsorted(hot, slot), len(hot) - 1)] == slot if len(hot) else np.zeros(len(slot), bool)
    return keep, is_hot & keep


def _in_turn(first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's document and its place among the document's segments."""
    doc = np.searchsorted(starts, first, "right") - 1
    return doc, np.arange(len(first)) - np.searchsorted(first, starts[:-1])[doc]


def hot_windows(hashes: np.ndarray, starts: np.ndarray, window: int, bitmap: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the windows under hot minimizers."""
    first, n, anchor = minimizers(hashes, starts, window)
    _, is_hot = _told(anchor, bitmap, hot)
    single = _gather(first[is_hot], n[is_hot])
    return single, _keys(hashes, single, np.full(len(single), window))


def _shared_segments(owned: DataFrame, window: int, bitmap, hot, total: int) -> DataFrame:
    """doc_id, text_key, ords: the numbers of the segments whose minimizer another document holds too, but for hot ones."""
    parts = max(total // PART + 1, int(owned.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4 + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            h, starts = hash_words(texts(b))
            first, _, anchor = minimizers(h, starts, window)
            keep, is_hot = _told(anchor, bitmap.value, hot.value)
            doc, turn = _in_turn(first, starts)
            on = np.flatnonzero(keep & ~is_hot)
            if not len(on):
                continue
            on = on[np.argsort(anchor[on])]
            anchor, doc, turn = anchor[on], doc[on], turn[on]
            part = ((anchor >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ids, keys = np.asarray(b.column("doc_id")).view(np.uint64) ^ _ID, np.asarray(b.column("text_key")).view(np.uint64)
            blobs = []
            for s, e in zip(cut, np.append(cut[1:], len(on)), strict=True):
                held, code = np.unique(doc[s:e], return_inverse=True)
                blobs.append(pack_sorted(anchor[s:e]) + pack(code) + pack(turn[s:e]) + pack(ids[held]) + pack(keys[held]))
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for r in map(Reader, b.column("blob").to_pylist()):
                anchor, code, turn, ids, keys = r.take_sorted(), r.counts(), r.counts(), r.take(), r.take()
                held.append((anchor, ids[code], keys[code], turn))
        if not held:
            return
        anchor, ids, keys, turn = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order, cut = distinct(anchor)
        two = np.minimum.reduceat(ids[order], cut) < np.maximum.reduceat(ids[order], cut)
        on = order[np.repeat(two, np.diff(np.append(cut, len(order))))]
        on = on[np.lexsort((keys[on], ids[on]))]
        ids, keys, turn = ids[on], keys[on], turn[on]
        if not len(on):
            return
        cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
        ords = pa.ListArray.from_arrays(pa.array(np.append(cut, len(on)).astype(np.int32)), pa.array(turn.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array((ids[cut] ^ _ID).view(np.int64)), pa.array(keys[cut].view(np.int64)), ords], ["doc_id", "text_key", "ords"])

    counted = owned.mapInArrow(count, "part int, blob binary").repartitionById(parts, F.col("part"))
    told = counted.mapInArrow(merge, "doc_id long, text_key long, ords array<int>")
    return stored(told.groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).agg(F.flatten(F.collect_list("ords")).alias("ords")), "shared")


#: Of a row (doc_id, text_key), its slot in a bitmap of rows.
_PLACE = f"shiftrightunsigned(xxhash64(doc_id, text_key), {64 - SLOTS})"


def _rows_of(marks: DataFrame, doc_id: str, text_key: str):
    """A broadcast bitmap of the rows that a table names, and a filter of Arrow batches with a column ``place`` by it."""
    bits = np.zeros(1 << (SLOTS - 3), np.uint8)
    place = F.shiftrightunsigned(F.xxhash64(doc_id, text_key), 64 - SLOTS)
    told = marks.groupBy(F.shiftright(place, 3).cast("int").alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(xxhash64({doc_id}, {text_key}), {64 - SLOTS}) & 7 as int))")).alias("bits"))
    for r in told.toArrow().to_batches():
        bits[np.asarray(r.column("byte"))] = np.asarray(r.column("bits")).astype(np.uint8)
    shared = marks.sparkSession.sparkContext.broadcast(bits)

    def may(b: pa.RecordBatch) -> pa.Array:
        at = np.asarray(b.column("place"))
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return may


def _gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _keys(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the segments' words, as far as segments carry them."""
    if not len(first):
        return np.empty(0, np.uint64)
    at = _gather(first, size)
    cut = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        place = (np.arange(len(at)) - np.repeat(cut, size) + 1).astype(np.uint64) * _ODD
        return mix(np.add.reduceat(mix((hashes[at] & _WORD) + place), cut) + size.astype(np.uint64))


def _search(sizes, flat, low, high, window: int) -> tuple[np.ndarray, ...]:
    """Of a shard's distinct segments, the runs of windows with a least owner below the segment's greatest document: segment,
    first word, word after the last, owner."""
    vocabulary, symbols = np.unique(flat, return_inverse=True)
    symbols = symbols + 1
    index = FMIndex(symbols, sizes, low, window)
    n = sizes - window + 1
    at = _gather(np.cumsum(sizes) - sizes, n)
    of = np.repeat(np.arange(len(sizes)), n)
    # a match in one place alone is the segment itself
    size, lo, hi = index.statistics(symbols, at + window, window, least=2)
    whole = size >= window
    owner = low[of]
    if whole.any():
        owner[whole] = index.least_owner(lo[whole], hi[whole])
    told = np.flatnonzero(owner < high[of])
    of, owner, offset = of[told], owner[told], at[told] - (np.cumsum(sizes) - sizes)[of[told]]
    new = np.flatnonzero(np.concatenate([[len(of) > 0], (of[1:] != of[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(offset) != 1)])) if len(of) else np.empty(0, np.int64)
    length = np.diff(np.append(new, len(of)))
    return of[new], offset[new], offset[new] + length + window - 1, owner[new]


def _blob(h, ids, keys, starts, first, size, key, order) -> bytes:
    """Segments ``order`` (by key) of a batch: sizes and words of the distinct ones, and the places of each: document, text, first word."""
    cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    one = order[cut]
    words = np.ascontiguousarray(h[_gather(first[one], size[one])].view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
    doc = np.searchsorted(starts, first[order], "right") - 1
    held, code = np.unique(doc, return_inverse=True)
    return b"".join([pack(size[one]), words, pack(np.diff(np.append(cut, len(order)))), pack(ids[held].view(np.uint64) ^ _ID), pack(keys[held].view(np.uint64)), pack(code), pack(first[order] - starts[doc])])


def _hot_blob(h, ids, keys, starts, first, size, key, order) -> bytes:
    """Hot windows: as _blob, with the least and the greatest document in place of the places."""
    cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    one = order[cut]
    words = np.ascontiguousarray(h[_gather(first[one], size[one])].view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
    doc = ids[np.searchsorted(starts, first[order], "right") - 1]
    low, high = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut)
    return b"".join([pack(size[one]), words, pack(low.view(np.uint64) ^ _ID), pack(high.view(np.uint64) ^ _ID)])


def _words(r: Reader, size: np.ndarray) -> np.ndarray:
    n = int(size.sum())
    out = np.zeros((n, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(r.raw, np.uint8, n * WORD_BYTES, r.at).reshape(-1, WORD_BYTES)
    r.at += n * WORD_BYTES
    return out.view(np.uint64).ravel()


def _shard(blobs: list[tuple[bytes, bool]], window: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A shard's findings: spans packed by parts of the documents, and (key, owner) of hot windows that stand in a document above the owner's."""
    sizes, flats, seg_low, seg_high, held = [], [], [], [], []
    base = 0
    for raw, is_hot in blobs:
        r = Reader(raw)
        size = r.take().astype(np.int64)
        flats.append(_words(r, size))
        sizes.append(size)
        if is_hot:
            seg_low.append((r.take() ^ _ID).view(np.int64))
            seg_high.append((r.take() ^ _ID).view(np.int64))
        else:
            n, ids, keys, code, at = r.take().astype(np.int64), (r.take() ^ _ID).view(np.int64), r.take().view(np.int64), r.take().astype(np.int64), r.take().astype(np.int64)
            cut = np.cumsum(n) - n
            seg_low.append(np.minimum.reduceat(ids[code], cut))
            seg_high.append(np.maximum.reduceat(ids[code], cut))
            held.append((np.repeat(np.arange(base, base + len(n)), n), ids[code], keys[code], at))
        base += len(size)
    size, flat, low, high = (np.concatenate(x) for x in (sizes, flats, seg_low, seg_high))
    hot = np.repeat([x for _, x in blobs], [len(x) for x in sizes])
    first = np.cumsum(size) - size
    key, one, same = np.unique(_keys(flat, first, size), return_index=True, return_inverse=True)
    least, most = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
    np.minimum.at(least, same, low)
    np.maximum.at(most, same, high)
    seg, begin, end, owner = _search(size[one], flat[_gather(first[one], size[one])], least, most, window)
    if not len(seg):
        return
    if held:
        of, doc, text, at = (np.concatenate(x) for x in zip(*held, strict=True))
        of = same[of]
        order = np.argsort(of, kind="stable")
        of, doc, text, at = of[order], doc[order], text[order], at[order]
        lo, hi = np.searchsorted(of, seg, "left"), np.searchsorted(of, seg, "right")
        run, place = np.repeat(np.arange(len(seg)), hi - lo), _gather(lo, hi - lo)
        keep = owner[run] < doc[place]
        run, place = run[keep], place[keep]
        doc, text, b, e = doc[place], text[place], at[place] + begin[run], at[place] + end[run]
        if len(doc):
            found = _packed(doc, text, b, e, parts)
            yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, pa.int64())] * 2], ["part", "blob", "key", "owner"])
    told = np.unique(seg[np.isin(seg, same[hot])])
    if len(told):
        best = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(best, seg, owner)
        none = [pa.nulls(len(told), pa.int32()), pa.nulls(len(told), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(key[told].view(np.int64)), pa.array(best[told])], ["part", "blob", "key", "owner"])


def _grouped(doc, text, begin, end) -> pa.RecordBatch:
    """(doc_id, text_key, spans): one row for each document's text, its spans as begin, end, begin, end..., joined where they meet."""
    order = np.lexsort((begin, text, doc))
    doc, text, begin, end = doc[order], text[order], begin[order], end[order]
    row = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]))
    shift = row * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] + shift[1:] > reach[:-1]]))
    stop = np.append(new[1:], len(row)) - 1
    flat = np.empty(2 * len(new), np.int32)
    flat[0::2], flat[1::2] = begin[new], reach[stop] - shift[stop]
    one = np.flatnonzero(np.concatenate([[True], row[new][1:] != row[new][:-1]]))
    spans = pa.ListArray.from_arrays(pa.array(np.append(2 * one, len(flat)).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(doc[new][one]), pa.array(text[new][one]), spans], ["doc_id", "text_key", "spans"])


def _packed(doc, text, begin, end, parts: int) -> pa.RecordBatch:
    """(part, blob) rows of spans, by parts of the documents."""
    part = (mix(doc.view(np.uint64) ^ mix(text.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((doc, part))
    cut = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
    blobs = [b"".join([pack(doc[x].view(np.uint64) ^ _ID), pack(text[x].view(np.uint64)), pack(begin[x]), pack(end[x] - begin[x])]) for x in np.split(order, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[order[cut]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = []
    for b in batches:
        for r in map(Reader, b.column("blob").to_pylist()):
            doc, text, begin = (r.take() ^ _ID).view(np.int64), r.take().view(np.int64), r.counts()
            found.append((doc, text, begin, begin + r.counts()))
    if found:
        yield _grouped(*(np.concatenate(x) for x in zip(*found, strict=True)))


_SPANS, _PACKED = "doc_id long, text_key long, spans array<int>", "part int, blob binary"


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, broadcast_rows: int = BROADCAST) -> DataFrame:
    """(doc_id, text_key, spans): word spans (begin, end, begin, end, ...) of each document covered by windows that a smaller document
    holds too.

    ``docs``: doc_id, text, text_key (a hash of the text).
    """
    if window <= GRAM:
        raise ValueError(f"windows of more than {GRAM} words")
    spark = docs.sparkSession
    owned = docs.filter("doc_id is not null").select("doc_id", "text_key", "text")
    bitmap, hot, total = _shared(owned, window)
    bitmap, hot = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(hot)
    shared = _shared_segments(owned, window, bitmap, hot, total)
    n_kept = shared.agg(F.coalesce(F.sum(F.size("ords")), F.lit(0))).first()[0]
    n_shards = max(n_kept * (window + (window - GRAM) // 2) // shard_words + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = n_shards // 4 + 1
    may = _rows_of(shared, "of", "of_key")

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(may(b)).select(["doc_id", "text_key", "text"])

    def dealt(b: pa.RecordBatch, h, starts, first, size, key, route, blob) -> pa.RecordBatch:
        shard = (mix(route) % np.uint64(n_shards)).astype(np.int64)
        order = np.lexsort((key, shard))
        cut = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
        ids, keys = np.asarray(b.column("doc_id")), np.asarray(b.column("text_key"))
        blobs = [blob(h, ids, keys, starts, first, size, key, order[s:e]) for s, e in zip(cut, np.append(cut[1:], len(order)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[order[cut]].astype(np.int32)), pa.array([blob is _hot_blob] * len(cut)), pa.array(blobs, pa.binary())], ["shard", "hot", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            h, starts = hash_words(texts(b))
            first, n, anchor = minimizers(h, starts, window)
            doc, turn = _in_turn(first, starts)
            ords = b.column("ords")
            of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(ords.offsets)))
            wide = int(turn.max(initial=0)) + 1
            told = np.asarray(ords.flatten()).astype(np.int64)
            on = np.isin(doc * wide + turn, (of * wide + told)[told < wide])
            if on.any():
                size = n[on] + window - 1
                yield dealt(b, h, starts, first[on], size, _keys(h, first[on], size), anchor[on], _blob)

    def deal_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            h, starts = hash_words(texts(b))
            first, key = hot_windows(h, starts, window, bitmap.value, hot.value)
            if len(first):
                yield dealt(b, h, starts, first, np.full(len(first), window), key, key, _hot_blob)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in zip(b.column("blob").to_pylist(), b.column("hot").to_pylist(), strict=True)]
        if blobs:
            yield from _shard(blobs, window, parts)

    schema = "shard int, hot boolean, blob binary"
    held = owned.withColumn("place", F.expr(_PLACE)).mapInArrow(sharing, "doc_id long, text_key long, text string")
    blobs = held.join(shared, (F.col("doc_id") == F.col("of")) & (F.col("text_key") == F.col("of_key"))).select("doc_id", "text_key", "text", "ords").mapInArrow(deal, schema)
    if len(hot.value):
        blobs = blobs.unionAll(owned.mapInArrow(deal_hot, schema))
    found = stored(blobs.repartitionById(n_shards, F.col("shard")).mapInArrow(search, _PACKED + ", key long, owner long"), "spans")
    release(shared)
    spans = found.filter("blob is not null").select("part", "blob")

    def gathered(spans: DataFrame) -> DataFrame:
        return spans.repartitionById(parts, F.col("part")).mapInArrow(_by_document, _SPANS)

    back = found.filter("blob is null").groupBy("key").agg(F.min("owner").alias("owner"))
    if not len(hot.value):
        return gathered(spans)
    n_back = back.count()
    if not n_back:
        return gathered(spans)
    known = None
    if n_back <= broadcast_rows:
        t = back.toArrow()
        key = np.asarray(t.column("key").combine_chunks()).view(np.uint64)
        order = np.argsort(key)
        known = spark.sparkContext.broadcast((key[order], np.asarray(t.column("owner").combine_chunks())[order]))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            h, starts = hash_words(texts(b))
            first, key = hot_windows(h, starts, window, bitmap.value, hot.value)
            doc = np.searchsorted(starts, first, "right") - 1
            ids, keys = np.asarray(b.column("doc_id"))[doc], np.asarray(b.column("text_key"))[doc]
            if known is None:
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(keys), pa.array((first - starts[doc]).astype(np.int32))], ["key", "doc_id", "text_key", "at"])
                continue
            wanted, owner = known.value
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = (wanted[at] == key) & (owner[at] < ids)
            if hit.any():
                begin = (first - starts[doc])[hit]
                yield _packed(ids[hit], keys[hit], begin, begin + window, parts)

    if known is not None:
        return gathered(spans.unionAll(owned.mapInArrow(places, _PACKED)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                begin = np.asarray(b.column("at")).astype(np.int64)
                yield _packed(np.asarray(b.column("doc_id")), np.asarray(b.column("text_key")), begin, begin + window, parts)

    at = owned.mapInArrow(places, "key long, doc_id long, text_key long, at int").join(back, "key").filter("owner < doc_id")
    return gathered(spans.unionAll(at.select("doc_id", "text_key", "at").mapInArrow(told, _PACKED)))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, broadcast_rows: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and kept, the remaining words, if ``with_text``).

    A word goes if a window of ``window`` words over it also starts in a document of smaller id, judged on the input.
    Null and short texts lose nothing. A null id is smaller than none, and none is smaller than it. Rows with one id
    don't take words from each other; repeated rows have equal results. An empty table gives no rows. Windows are compared
    by 40 bits of each word's hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    marks = stored(repeated_spans(rows, window, shard_words, broadcast_rows), "marks")
    may = _rows_of(marks, "doc_id", "text_key")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def told(b: pa.RecordBatch, rows: list[bytes], spans: list) -> pa.RecordBatch:
        words, gone, sha, left = [], [], [], []
        for text, span in zip(rows, spans, strict=True):
            w = text.split()
            words.append(len(w))
            if span is not None:
                cover, span = np.zeros(len(w) + 1, np.int64), np.asarray(span)
                np.add.at(cover, span[0::2], 1)
                np.add.at(cover, span[1::2], -1)
                w = [x for x, k in zip(w, (np.cumsum(cover)[:-1] == 0).tolist(), strict=True) if k]
            gone.append(words[-1] - len(w))
            kept = b" ".join(w)
            sha.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)] + [pa.array(left)] * with_text, names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            b = b.filter(pc.invert(may(b)))
            if b.num_rows:
                yield told(b, texts(b), [None] * b.num_rows)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(may(b)).select(["doc_id", "text_key", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield told(b, texts(b), b.column("spans").to_pylist())

    placed = rows.withColumn("place", F.expr(_PLACE))
    held = placed.mapInArrow(moved, "doc_id long, text_key long, text string").join(marks.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "spans"), (F.col("doc_id") == F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    return placed.mapInArrow(clean, schema).unionAll(held.select("doc_id", "text", "spans").mapInArrow(cut, schema))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM d)),
o AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
h AS (SELECT g.doc_id, list(i) AS starts FROM g JOIN o USING (k) WHERE o.least < g.doc_id GROUP BY g.doc_id),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(s, s + 12)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM h)) GROUP BY doc_id),
r AS (SELECT d.doc_id, ws, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN ws ELSE list_select(ws, list_sort(list_filter(generate_series(1, len(ws)), lambda x: NOT list_contains(gone, x)))) END AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""
