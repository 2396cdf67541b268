"""Language-model scoring with a probabilistic suffix tree over words.

Contexts of one to ``DEPTH`` words are kept where they are frequent and where what follows them diverges from what
follows their own suffix (count times Kullback-Leibler divergence, against a cost per symbol). Each kept state holds
discounted probabilities of its frequent next words, and leaves the rest to its suffix, down to the root, the add-one
distribution of single words; so every state's distribution sums to one over the root's words. A word is scored in the
state of the longest kept suffix of the words before it.

A context needs a least number of occurrences, whatever the corpus holds, so the tree grows with the corpus. It is a written
table of (key, value): a state's value is the log10 of what it leaves to its suffix, a transition's how far its probability
exceeds its suffix's, less the state's value. Since suffixes of kept states are kept, and a state's transitions are its
suffix's too, a word's log10 probability is the root's plus the values of all entries found, so scores are sums of
look-ups in any order. The most frequent entries are broadcast up to a stated number; the texts ask for all others in
packed batches dealt by key, and get sums by document back, one row a batch and part.

Bitmaps of fixed size spare look-ups that nothing can answer, and decide nothing: one that is full spares fewer. Every count
covers the whole training corpus. Batches are counted before they move and go as one row a part (``packing``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.durable import release, stored, sweep
from skein.llm.packing import Bitmap, Reader, Table, ascending, bitmaps, distinct, pack, pack_small, pack_sorted, take_small, trim
from skein.llm.text import doc_of, hash_words, held_out, mix, slices, small_batches, texts

#: Words of a context at most, occurrences that a context and a transition need, and the discount of each count.
DEPTH, CONTEXT, NEXT, DISCOUNT = 3, 5, 2, 0.5
#: Cost of a transition in the divergence test, in nats of count times divergence.
COST = 2.0
#: Words whose root counts are broadcast, and entries of the tree, at most.
HEAD, HOT = 500_000, 2_000_000
#: Tokens, and entries of the tree, that a part gets on average. Parts follow the data alone: each part sends each other a row.
PART_TOKENS, PART_ENTRIES = 4_000_000, 2_000_000
#: A part's contexts are summed in so many ranges, one after the other.
PIECES = 8
#: The end token, a word that no text holds.
END = np.uint64(0x6A09E667F3BCC909)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 4 << 20
#: Bytes of texts that are scored at a time: each token has several look-ups.
_ASK = 2 << 20
#: Transitions know words by 48 bits of their hashes, look-ups of the written tables their keys by 56.
_CODE, _CODED, _ASKED = np.uint64(16), np.uint64(0xFFFFFFFFFFFF0000), np.uint64(0xFFFFFFFFFFFFFF00)


def tokens(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's lower-cased words with an end after each text, and where each text starts."""
    hashes, starts = hash_words(rows, lower=True)
    out = np.full(len(hashes) + len(rows), END)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(rows)), np.diff(starts))] = hashes
    return out, starts + np.arange(len(starts))


def _pairs(context: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(context * _ODD + code)


def contexts(code: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 0 to ``depth`` words: the hash of so many words before each token (0 where the text has fewer), and of these with the token.
    A context's hash is that of its words but the last, paired with the last: the token before has it."""
    far = np.arange(len(code)) - np.repeat(starts[:-1], np.diff(starts))
    context = np.zeros(len(code), np.uint64)
    for d in range(depth + 1):
        if d:
            context = np.concatenate([context[:1] * np.uint64(0), key[:-1]])  # noqa: F821
            context[far < d] = 0
        key = _pairs(context, code)
        yield context, key


def _followed(c: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens after contexts: one place of each distinct pair, its count, and where each context starts, by one sort. Contexts
    ascend by the top half of their hashes; the few contexts, or words after one, that share halves may come more than once."""
    low = np.uint64(0xFFFFFFFF)
    order = np.argsort(c & ~low | (_pairs(c, code) & low))
    c, code = c[order], code[order]
    start = np.concatenate([np.ones(min(1, len(c)), bool), c[1:] != c[:-1]])
    new = start.copy()
    new[1:] |= code[1:] != code[:-1]
    cut = np.flatnonzero(new)
    return order[cut], np.diff(np.append(cut, len(order))), np.flatnonzero(start[cut])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal ranges of 64-bit keys, ascending with them."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _edges(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending keys, without empty parts."""
    if not len(keys):
        return []
    part = _part(keys, parts)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return list(zip(part[cut].tolist(), cut.tolist(), np.append(cut[1:], len(keys)).tolist(), strict=True))


def _dealt(keys: np.ndarray, parts: int, tag: bytes, *others: np.ndarray) -> list[tuple[int, bytes]]:
    """Blobs of the keys, ascending, and of what belongs to them, by the keys' parts."""
    order = np.argsort(keys)
    keys, others = keys[order], [x[order] for x in others]
    return [(p, b"".join([tag, pack_sorted(keys[s:e]), *(pack(x[s:e]) for x in others)])) for p, s, e in _edges(keys, parts)]


_BLOB = "part int, blob binary"


def _rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["part", "blob"])


def _spread(frame: DataFrame, deal: Callable[[Reader], list[tuple[int, bytes]]]) -> DataFrame:
    """(part, blob) rows of what ``deal`` makes of each blob of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob").to_pylist():
                yield _rows(deal(Reader(blob)))

    return frame.select("blob").mapInArrow(run, _BLOB)


def _joined(sources: list[DataFrame], parts: int, merge: Callable[[dict[bytes, list[Reader]]], list[np.ndarray] | None], name: str, first: int | None = None) -> DataFrame:
    """A table of one blob a part (n, blob), of the arrays that ``merge`` makes of a part's blobs, listed by their tags. The first
    ``first`` arrays, if told, are a table of their own (v, words) beside it."""
    every = sources[0]
    for x in sources[1:]:
        every = every.unionAll(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list[Reader]]] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                held.setdefault(part, {}).setdefault(blob[:1], []).append(Reader(blob, 1))
        while held:
            out = merge(held.popitem()[1])
            trim()
            if out is not None and len(out[0]):
                tables = [out[first:], out[:first]] if first else [out]
                yield pa.RecordBatch.from_arrays([c for x in tables for c in (pa.array([len(x[0])]), pa.array([b"".join(map(pack, x))], pa.binary()))], ["n", "blob", "v", "words"][: 2 * len(tables)])

    return stored(every.repartitionById(parts, F.col("part")).mapInArrow(run, "n long, blob binary" + (", v long, words binary" if first else "")), name)


def _taken(readers: list[Reader] | None, *kinds: type) -> list[np.ndarray]:
    """The arrays of all blobs of one tag, end to end; the first is the ascending keys, the others as numpy types. What is read is
    given up: the readers one by one, then the pieces of each array."""
    found: list[list[np.ndarray]] = [[np.empty(0, k)] for k in (np.uint64, *kinds)]
    readers = readers or []
    readers.reverse()
    while readers:
        r = readers.pop()
        for x, a in zip(found, (r.take_sorted(), *(r.take().view(k) for k in kinds)), strict=True):
            x.append(a)
    out = []
    while found:
        out.append(np.concatenate(found.pop(0)))
    return out


def _rowcount(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _bitmaps(table: DataFrame, keys_of: Callable[[Reader], list[np.ndarray]], n: int, sets: int = 1) -> list[Bitmap]:
    def keys(b: pa.RecordBatch) -> list[np.ndarray]:
        found = [keys_of(Reader(x)) for x in b.column("blob").to_pylist()]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    return bitmaps(table.select("blob"), keys, n, sets)


def _fixed(x: np.ndarray) -> np.ndarray:
    """Doubles to 2 ** -36, which have five bytes or six instead of eight; the sign goes last."""
    x = np.rint(x * 2.0**36).astype(np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unfixed(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)) * 2.0**-36


def _above(table: DataFrame, at: int, names: int, most: int, steps: bool = False) -> tuple[int, list[np.ndarray]]:
    """Of a table's first ``names`` arrays, the elements whose count (array ``at``) is at least one that at most ``most`` have; and this
    least count, an eighth of a power of two."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob").to_pylist():
                r = Reader(blob)
                n = [r.take() for _ in range(at + 1)][at].astype(np.float64)
                size, k = np.unique(np.floor(8 * np.log2(n)).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(k)], ["size", "k"])

    found = {r.size: r.k for r in table.select("blob").mapInArrow(sizes, "size int, k long").groupBy("size").agg(F.sum("k").alias("k")).collect()}
    least, held = 1 << 62, 0
    for size in sorted(found, reverse=True):
        held += found[size]
        if held > most:
            break
        least = int(np.ceil(2 ** (size / 8) * (1 - 1e-12)))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob").to_pylist():
                r = Reader(blob)
                held = [r.take_sorted() if steps and not k else r.take() for k in range(names)]
                on = held[at] >= least
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(pack(x[on]) for x in held)], pa.binary())], ["blob"])

    rows = [Reader(bytes(r.blob)) for r in table.select("blob").mapInArrow(chosen, "blob binary").collect()]
    parts = [[r.take() for _ in range(names)] for r in rows]
    return least, [np.concatenate([np.empty(0, np.uint64), *x]) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64)] * names


def _codes(r: Reader) -> tuple[np.ndarray, np.ndarray]:
    """Of a part of the word counts: each code as a context of one word, and its count."""
    word, n = r.take(), r.counts()
    code = word >> _CODE
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return _pairs(np.zeros(len(first), np.uint64), code[first]), np.add.reduceat(n, first)


@dataclass
class Tree:
    """head: frequent words, with log10 of their P at the root and what they leave to the next token as a state, NaN where the
    written tables may hold that (both with a last row for all other words); keys of the frequent entries, with their values as a transition to a token and as a
    state of the next one; a
    bitmap of the keys of all entries that aren't here (cold)."""

    n: int
    v: int
    depth: int
    head: Table
    roots: np.ndarray
    singles: np.ndarray
    keys: Table
    values: np.ndarray
    backs: np.ndarray
    cold: Bitmap

    @staticmethod
    def of(n: int, v: int, depth: int, head: Table, counts: np.ndarray, keys: Table, values: np.ndarray, backs: np.ndarray, cold: Bitmap) -> Tree:
        key = _pairs(np.zeros(len(counts), np.uint64), head.keys >> _CODE)
        place, hit = keys.find(key)
        singles = np.full(len(counts) + 1, np.nan)
        singles[:-1][hit] = backs[place[hit]]
        singles[:-1][~hit & ~cold.may(key)] = 0
        return Tree(n, v, depth, head, np.log10((np.append(counts, 0) + 1) / (n + v + 1)), singles, keys, values, backs, cold)

    def __reduce__(self):
        return _tree, (self.n, self.v, self.depth, self.head, self.roots, self.singles, self.keys, pack(_fixed(self.values)), pack(_fixed(self.backs)), self.cold)

    def asked(self, h: np.ndarray, starts: np.ndarray, known: np.ndarray | None = None):
        """(tokens, keys) of the look-ups that the frequent entries answer, their places, and (tokens, keys) of those that others
        may answer, context by context: a token with so many words before it is a transition, and a state of the next token.
        Tokens that are ``known`` as states aren't asked alone."""
        there = np.ones(len(h), bool) if known is None else ~known
        for d, (c, key) in enumerate(contexts(h >> _CODE, starts, self.depth)):
            on = there if d == 0 else c != 0
            if d > 1:  # a transition's suffix is one too, and a state's: where the shorter one isn't, this one isn't
                on &= there
            if d == self.depth > 1:  # transitions alone, and only of states
                on[1:] &= there[:-1]
            on = np.flatnonzero(on).astype(np.int32)
            key = key[on]
            place, hit = self.keys.find(key)
            rest = np.flatnonzero(~hit)
            rest = rest[self.cold.may(key[rest])]
            here, rest, key = on[hit], on[rest], key[rest]
            there = np.zeros(len(h), bool)
            there[here] = there[rest] = True
            yield here, place[hit], rest, key

    def root(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each token is in the head, log10 of its P at the root (of count 0 outside the head), and what it is as a state (NaN
        where that isn't known here)."""
        place, known = self.head.find(h)
        place = np.where(known, place, len(self.head.keys))
        return known, self.roots.take(place), self.singles.take(place)

    def scores(self, h: np.ndarray, starts: np.ndarray):
        """Per token: whether it is in the head, log10 of its P at the root, the sum of the frequent entries' values; and (token, key)
        of the look-ups that only the written tables can answer: words outside the head, and cold entries."""
        known, root, single = self.root(h)
        first = np.zeros(len(h) + 1, bool)
        first[starts] = True
        sure = single == single
        more, rest = np.zeros(len(h)), np.flatnonzero(~known).astype(np.int32)
        more[1:] = np.where(sure & ~first[1:], single, 0)[:-1]
        at, keys = [rest], [mix(h[rest] ^ _ODD)]
        for here, found, token, key in self.asked(h, starts, sure):
            more[here] += self.values[found]  # a token asks once a step
            on = ~first[here + 1]
            more[here[on] + 1] += self.backs[found[on]]
            at.append(token)
            keys.append(key)
        return known, root, more, np.concatenate(at), np.concatenate(keys) & _ASKED


def _tree(n, v, depth, head, roots, singles, keys, values, backs, cold) -> Tree:
    return Tree(n, v, depth, head, roots, singles, keys, *(_unfixed(Reader(x).take()) for x in (values, backs)), cold)


def _back(whole: np.ndarray, held: np.ndarray, fan: np.ndarray) -> np.ndarray:
    """What a state leaves to its suffix, of its occurrences, those of its transitions and their number."""
    return np.maximum(1e-12, 1 - (held - DISCOUNT * fan) / whole)


def _states(c, above, whole, fan, code, n) -> list[np.ndarray]:
    """Of contexts with their counts in several batches, and of what follows them: context, above, whole, held, fan; code, n."""
    at, over = np.repeat(c, fan), np.repeat(above, fan)
    order, cut = distinct(c)
    names, total = c[order][cut], np.add.reduceat(whole[order], cut)
    order, cut = distinct(_pairs(at, code))
    count, one = (np.add.reduceat(n[order], cut), order[cut]) if len(n) else (n, order)
    keep = count >= NEXT
    count, one = count[keep], one[keep]
    state = np.searchsorted(names, at[one])
    keep = total[state] >= CONTEXT
    count, one, state = count[keep], one[keep], state[keep]
    order, cut = distinct(state)
    count, one, state = count[order], one[order], state[order]
    fans, who = np.diff(np.append(cut, len(state))), state[cut]
    held = np.add.reduceat(count, cut) if len(count) else count
    return [names[who], over[one[cut]], total[who], held, fans, code[one], count]


def _pieces(held: list[tuple[np.ndarray, ...]], each: Callable) -> list[np.ndarray]:
    """What ``each`` makes of a part's contexts and what follows them, range by range of the top
    halves of their hashes, by which they ascend. A blob's arrays are by context, the numbers of followers last, and two by follower."""
    half = [x[0] >> np.uint64(32) for x in held]
    low, high = min(int(x[0]) for x in half), max(int(x[-1]) for x in half)
    cuts = [low + (high - low) * k // PIECES for k in range(1, PIECES)]
    edges = [np.array([0, *np.searchsorted(x, np.array(cuts, np.uint64)), len(x)]) for x in half]
    moves = [np.concatenate([[0], np.cumsum(x[-3])]) for x in held]
    out = []
    for k in range(PIECES):
        spans = [(int(e[k]), int(e[k + 1])) for e in edges]
        some = [[a[s:e] for a in x[:-2]] + [a[m[s] : m[e]] for a in x[-2:]] for x, m, (s, e) in zip(held, moves, spans, strict=True)]
        found = [np.concatenate(x) for x in zip(*some, strict=True)]
        if len(found[0]):
            out.append(each(*found))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _words(train: DataFrame, parts: int) -> DataFrame:
    """A table by ranges of words: each word with its count (v, words), and the contexts of one word with what follows them, as
    ``_gathered`` has them (n, blob). Every word but the end is followed once each time it occurs, so contexts tell the counts. Words
    of one 48-bit code, the first ones, lie in one part and piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            h, starts = tokens(texts(b))
            inner = np.ones(len(h), bool)
            inner[starts[:-1]] = False
            at = np.flatnonzero(inner)
            some, n, cut = _followed(h[at - 1], h[at] >> _CODE)
            at = at[some]
            name, whole, fan = h[at[cut] - 1], np.add.reduceat(n, cut) if len(n) else n, np.diff(np.append(cut, len(at)))
            end = np.searchsorted(name >> np.uint64(32), END >> np.uint64(32))
            name, whole, fan = np.insert(name, end, END), np.insert(whole, end, b.num_rows), np.insert(fan, end, 0)
            ends, code = np.concatenate([[0], np.cumsum(fan)]), h[at] >> _CODE
            del some, inner, h, at
            trim()
            yield _rows([(p, b"".join([b"C", pack_sorted(name[s:e]), pack(whole[s:e]), pack(fan[s:e]), pack(code[ends[s] : ends[e]]), pack(n[ends[s] : ends[e]])])) for p, s, e in _edges(name, parts)])

    def each(word, whole, fan, code, n) -> list[np.ndarray]:
        order, cut = distinct(word)
        found = _states(_pairs(np.zeros(len(word), np.uint64), word >> _CODE), np.zeros(len(word), np.uint64), whole, fan, code, n)
        return [word[order][cut], np.add.reduceat(whole[order], cut), *found]

    def merge(kinds: dict[bytes, list[Reader]]) -> list[np.ndarray]:
        return _pieces([(r.take_sorted(), r.counts(), r.counts(), r.take(), r.counts()) for r in kinds.pop(b"C")], each)

    return _joined([train.mapInArrow(count, _BLOB)], parts, merge, "words", 2)


@dataclass
class Names:
    """Frequent words by their rank, from 1: most ranks have a byte or two, where codes have six."""

    table: Table
    rank: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(word: np.ndarray, count: np.ndarray) -> Names:
        key, first = np.unique(word & _CODED, return_index=True)
        order = np.argsort(count[first])[::-1]
        rank = np.empty(len(key), np.uint32)
        rank[order] = np.arange(1, len(key) + 1)
        return Names(Table(key), rank, np.concatenate([np.zeros(1, np.uint64), key[order] >> _CODE]))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """0 for a word that has none."""
        place, hit = self.table.find(h & _CODED)
        return np.where(hit, self.rank[place], 0) if len(self.rank) else np.zeros(len(h), np.uint32)

    @staticmethod
    def packed(rank: np.ndarray, code: np.ndarray) -> bytes:
        return pack(rank) + pack(code[rank == 0])

    def take(self, r: Reader) -> np.ndarray:
        rank, code = r.counts(), r.take()
        out = self.codes[rank]
        out[rank == 0] = code
        return out


def _gathered(train: DataFrame, d: int, parts: int, frequent: Bitmap, words: Bitmap, shorter: Bitmap, names: Names) -> DataFrame:
    """A table by ranges of contexts: the contexts of ``d`` words that occur ``CONTEXT`` times (context, above: its suffix, whole, held,
    fan), and the words that follow ``NEXT`` times (code, n). What follows a context so often follows
    its suffix so often, so the bitmaps lose none. Blobs name a context's suffix by its words."""
    broadcast = train.sparkSession.sparkContext.broadcast
    shared = [broadcast(x) for x in (frequent, words, shorter, names)]
    frequent, words, shorter, names = shared

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            h, starts = tokens(texts(b))
            code, last = h >> _CODE, None
            for step in contexts(code, starts, d):
                (_, suffix), last = last or step, step
            c, _ = last
            on = np.flatnonzero(c != 0)
            on = on[frequent.value.may(c[on])]
            if not len(on):
                continue
            at, n, cut = _followed(c[on], code[on])
            at = on[at]
            whole = np.add.reduceat(n, cut)
            keep = words.value.may(h[at])
            keep[keep] = shorter.value.may(suffix[at[keep]])
            fan = np.add.reduceat(keep.astype(np.int64), cut)
            ends = np.concatenate([[0], np.cumsum(fan)])
            del on, suffix, last
            first, followed, held = at[cut], at[keep], n[keep]
            name, over = c[first], [first - k for k in range(1, d)]
            over, followed = [(names.value.ranks(h[x]), code[x]) for x in over], (names.value.ranks(h[followed]), code[followed])
            del h, code, c, at
            trim()
            some = lambda x, s, e: Names.packed(x[0][s:e], x[1][s:e])
            yield _rows([(p, b"".join([b"C", pack_sorted(name[s:e]), *(some(x, s, e) for x in over), pack(whole[s:e]), pack(fan[s:e]), some(followed, ends[s], ends[e]), pack(held[ends[s] : ends[e]])])) for p, s, e in _edges(name, parts)])

    def blob(r: Reader) -> tuple[np.ndarray, ...]:
        name = r.take_sorted()
        above = np.zeros(len(name), np.uint64)
        for code in [names.value.take(r) for _ in range(1, d)][::-1]:
            above = _pairs(above, code)
        return name, above, r.counts(), r.counts(), names.value.take(r), r.counts()

    def merge(kinds: dict[bytes, list[Reader]]) -> list[np.ndarray]:
        return _pieces([blob(r) for r in kinds.pop(b"C")], _states)

    out = _joined([train.mapInArrow(count, _BLOB)], parts, merge, f"contexts-{d}")
    for x in shared:
        x.destroy()
    return out


def _level(raw: DataFrame, lower: DataFrame, parts: int, d: int) -> DataFrame:
    """A table of context, key, n, ends, whole, held, fan, under of the transitions: each meets its suffix's P, dealt by that one's key."""

    def ask(r: Reader) -> list[tuple[int, bytes]]:
        name, above, whole, held, fan, code, n = r.take(), r.take(), r.counts(), r.counts(), r.counts(), r.take(), r.counts()
        name, above, whole, held, fan = (np.repeat(x, fan) for x in (name, above, whole, held, fan))
        return _dealt(_pairs(above, code), parts, b"Q", _pairs(name, code), name, whole, held, fan, n, code == END >> _CODE)

    def merge(kinds: dict[bytes, list[Reader]]) -> list[np.ndarray]:
        suffix, key, context, whole, held, fan, n, ends = _taken(kinds.get(b"Q"), np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64)
        keys, ps = _taken(kinds.get(b"P"), np.float64)
        order = np.argsort(keys)
        place, hit = Table(keys[order]).find(suffix)
        under = ps[order][place[hit]] if len(ps) else np.empty(0)
        return [*(x[hit] for x in (context, key, n, ends, whole, held, fan)), under]

    return _joined([_spread(raw, ask), lower], parts, merge, f"level-{d}")


@dataclass
class Moves:
    """A level's blob, and what follows from it."""

    context: np.ndarray
    key: np.ndarray
    n: np.ndarray
    ends: np.ndarray
    whole: np.ndarray
    back: np.ndarray
    under: np.ndarray

    @staticmethod
    def of(r: Reader) -> Moves:
        context, key, n, ends, whole, held, fan = r.take(), r.take(), r.counts(), r.take(), r.counts(), r.counts(), r.counts()
        return Moves(context, key, n, ends, whole, _back(whole, held, fan), r.floats())

    def p(self) -> np.ndarray:
        return (self.n - DISCOUNT) / self.whole + self.back * self.under

    def gain(self) -> np.ndarray:
        return self.n * np.log(self.n / self.whole / self.under)

    def value(self) -> np.ndarray:
        return np.log10(self.p() / self.under) - np.log10(self.back)


def _nodes(raw: DataFrame, level: DataFrame, parts: int, d: int) -> DataFrame:
    """A table of context, above, whole, held, fan, passes."""

    def gains(r: Reader) -> list[tuple[int, bytes]]:
        moves = Moves.of(r)
        order, cut = distinct(moves.context)
        return _dealt(moves.context[order][cut], parts, b"G", np.add.reduceat(moves.gain()[order], cut), np.diff(np.append(cut, len(order)))) if len(order) else []

    def merge(kinds: dict[bytes, list[Reader]]) -> list[np.ndarray]:
        names, above, whole, held, fan = _taken(kinds.get(b"N"), np.uint64, np.int64, np.int64, np.int64)
        context, gain, n = _taken(kinds.get(b"G"), np.float64, np.int64)
        order = np.argsort(names)
        names, above, whole, held, fan = (x[order] for x in (names, above, whole, held, fan))
        place, _ = Table(names).find(context)
        passes = np.bincount(place, gain, len(names)) > COST * np.bincount(place, n, len(names))
        return [names, above, whole, held, fan, passes]

    return _joined([_spread(level, gains), _spread(raw, lambda r: _dealt(r.take(), parts, b"N", *(r.take() for _ in range(4))))], parts, merge, f"nodes-{d}")


def _needed(nodes: DataFrame, longer: DataFrame | None, parts: int, d: int) -> DataFrame:
    """A table of context, above, whole, held, fan of the nodes that pass or are the suffix of one in ``longer``."""

    def merge(kinds: dict[bytes, list[Reader]]) -> list[np.ndarray] | None:
        names, above, whole, held, fan, passes = _taken(kinds.get(b"N"), *[np.uint64] * 5)
        keep = passes > 0
        keep[np.searchsorted(names, ascending(_taken(kinds.get(b"S"))[0]))] = True
        return [x[keep] for x in (names, above, whole, held, fan)]

    sources = [_spread(nodes, lambda r: _dealt(r.take(), parts, b"N", *(r.take() for _ in range(5))))]
    if longer is not None:
        sources.append(_spread(longer, lambda r: (r.take(), _dealt(ascending(r.take()), parts, b"S"))[1]))
    return _joined(sources, parts, merge, f"kept-{d}")


def _branch(level: DataFrame, kept: DataFrame, parts: int, d: int) -> DataFrame:
    """The kept states and their transitions as a table of key (ascending, by steps), n, value, whether it is a state."""

    def arcs(r: Reader) -> list[tuple[int, bytes]]:
        moves = Moves.of(r)
        return _dealt(moves.context, parts, b"M", moves.key, moves.n, _fixed(moves.value()))

    def states(r: Reader) -> list[tuple[int, bytes]]:
        name, _, whole, held, fan = r.take(), r.take(), r.counts(), r.counts(), r.counts()
        return _dealt(name, parts, b"K", whole, _fixed(np.log10(_back(whole, held, fan))))

    def merge(kinds: dict[bytes, list[Reader]]) -> list[np.ndarray]:
        names, whole, back = _taken(kinds.get(b"K"), np.int64, np.uint64)
        context, key, k, value = _taken(kinds.get(b"M"), np.uint64, np.int64, np.uint64)
        order = np.argsort(names)
        _, on = Table(names[order]).find(context)
        out = [np.concatenate(x) for x in ([names, key[on]], [whole, k[on]], [back, value[on]], [np.ones(len(names), bool), np.zeros(on.sum(), bool)])]
        order = np.argsort(out[0])
        key, *others = (x[order] for x in out)
        return [np.diff(key, prepend=np.uint64(0)), *others]

    return _joined([_spread(level, arcs), _spread(kept, states)], parts, merge, f"suffix-tree-{d}")


def grow(train: DataFrame, raw: DataFrame, counts: DataFrame, names: Names, n: int, v: int, depth: int) -> DataFrame:
    """The tree, of the contexts of one word and the word counts: a table of key, n, value of its states and transitions, and
    whether it is a state. A state's key is that of the transition that its last word is, and both have one count: every word of a
    context is followed by a token."""
    parts = n // PART_TOKENS + 1

    def roots(r: Reader) -> list[tuple[int, bytes]]:
        key, whole = _codes(r)
        on = whole >= NEXT
        return _dealt(key[on], parts, b"P", (whole[on] + 1) / float(n + v + 1))

    def follow(r: Reader) -> list[np.ndarray]:
        _, key, k, ends = r.take(), r.take(), r.counts(), r.take()
        return [key[(k >= CONTEXT) & (ends == 0)], key]

    def spell(r: Reader) -> list[np.ndarray]:
        word, k = r.take(), r.counts()
        return [word[k >= NEXT]]

    def passed(r: Reader) -> list[tuple[int, bytes]]:
        moves = Moves.of(r)
        return _dealt(moves.key, parts, b"P", moves.p())

    words = _bitmaps(counts, spell, v)[0]
    lower, nodes, levels = _spread(counts, roots), [], []
    for d in range(1, depth + 1):
        if d > 1:
            frequent, shorter = _bitmaps(levels[-1], follow, _rowcount(levels[-1]), 2)
            raw = _gathered(train, d, parts, frequent, words, shorter, names)
        levels.append(_level(raw, lower, parts, d))
        nodes.append(_nodes(raw, levels[-1], parts, d))
        release(raw)
        lower = _spread(levels[-1], passed)
    kept, branches = None, []
    for d in range(depth, 0, -1):
        longer, kept = kept, _needed(nodes[d - 1], kept, parts, d)
        release(nodes[d - 1], *[longer] * (longer is not None))
        branches.append(_branch(levels[d - 1], kept, parts, d))
        release(levels[d - 1])
    release(kept)
    return reduce(DataFrame.unionAll, branches)


def plant(train: DataFrame, head: int = HEAD, depth: int = DEPTH, hot: int = HOT) -> tuple[Tree, Callable[[int], DataFrame], int]:
    """The tree's frequent part; all that the written tables hold beside it (words outside the head, cold entries), as blobs of key,
    value, word (1 or 0) dealt over a number of parts; and the number of these entries."""
    raw = _words(train, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = stored(raw.select(F.col("v").alias("n"), F.col("words").alias("blob")), "counts")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int((r.take(), r.counts())[1].sum()) for r in map(Reader, b.column("blob").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    v, n = _rowcount(counts), counts.select("blob").mapInArrow(sums, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least, (word, count) = _above(counts, 1, 2, head)
    order = np.argsort(word)
    table = grow(train, raw, counts, Names.of(word, count), n, v, depth)
    often, (key, _, value, state) = _above(table, 1, 4, hot, steps=True)
    n_rest, size = v - len(word) + _rowcount(table) - len(key), _rowcount(table)
    order_of, cut = distinct(key)
    key, of = key[order_of][cut], np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(key))))
    value, state = _unfixed(value[order_of]), state[order_of] > 0
    values, backs = (np.bincount(of[on], value[on], len(key)) for on in (~state, state))

    def spared(r: Reader) -> list[np.ndarray]:
        key, n = r.take_sorted(), r.counts()
        return [key[n < often]]

    def chilled(r: Reader) -> tuple[np.ndarray, np.ndarray]:
        key, n, value = r.take_sorted(), r.counts(), r.take()
        return key[n < often], value[n < often]

    def rare(r: Reader) -> tuple[np.ndarray, np.ndarray]:
        word, n = r.take(), r.counts()
        return mix(word[n < least] ^ _ODD), _fixed(np.log10(n[n < least] + 1.0))

    def rest(parts: int) -> DataFrame:
        def entries(of, is_word: int):
            def deal(r: Reader) -> list[tuple[int, bytes]]:
                key, value = of(r)
                return _dealt(key & _ASKED, parts, b"E", value, np.full(len(key), is_word))

            return deal

        return _spread(counts, entries(rare, 1)).unionAll(_spread(table, entries(chilled, 0)))

    tree = Tree.of(n, v, depth, Table(word[order]), count[order].view(np.int64), Table(key), values, backs, *_bitmaps(table, spared, size))
    return tree, rest, n_rest


def score_texts(docs: DataFrame, hold: tuple[int, int] = (7, 2), head: int = HEAD, depth: int = DEPTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from all rows but those with crc32(id) mod hold[0] = hold[1]. base_score is the add-one score of single words,
    score the tree's log10 probability; both count the end of the text as a token. A null text is empty, and has its end
    alone. Repeated rows count and are scored each; a null id counts as the empty text in the hash. Without training rows
    every token has probability 1 by the stated formula. Words are known by 64-bit hashes, in the tree by 48 bits of
    these. Texts are scored in ``rounds`` by their ids' hashes (2 where entries fill several parts), so that the look-ups of
    one round are gone before the next.
    An empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = rows.filter(~held_out("doc_id", *hold)).select("text")
    tree, rest, n_rest = plant(train, head, depth, hot)
    shared = spark.sparkContext.broadcast(tree)
    rounds = rounds or (1 if n_rest < PART_ENTRIES else 2)
    parts = n_rest // PART_ENTRIES + tree.n // (2 * rounds * PART_TOKENS) + 1
    homes = tree.n // PART_TOKENS + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Look-ups as distinct keys, how often each is asked, and by which of the batch's documents; and all that is known here.
        A batch is known by its task and number, and by a hash of its words, should a task that runs again cut it otherwise."""
        task = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, limit=_ASK)):
            h, starts = tokens(texts(b))
            name = np.array([task << 32 | k, xxhash.xxh3_64_intdigest(h.tobytes()), b.num_rows], np.uint64)
            home = int(mix(name[:1])[0] % np.uint64(homes))
            known, root, more, token, key = shared.value.scores(h, starts)
            add = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731, B023  every text has a token
            base = add(root)
            order = np.argsort(key)
            key, doc = key[order], doc_of(starts)[token[order]]
            edges = _edges(key, parts)
            told = [(home % parts, b"".join([b"D", pack(np.array([home])), pack(name), pack(np.array([len(edges)])), *(pack(np.asarray(b.column(c)).view(np.uint64)) for c in ("doc", "unnamed")), pack(np.diff(starts)), pack(add(known.astype(np.int64))), pack(base), pack(base + add(more))]))]
            for p, s, e in edges:
                cut = np.flatnonzero(np.concatenate([[True], key[s:e][1:] != key[s:e][:-1]]))
                told.append((p, b"".join([b"A", pack_sorted(key[s:e][cut]), pack(np.diff(np.append(cut, e - s))), pack_small(doc[s:e]), pack(np.array([home])), pack(name)])))
            del h, known, root, more, token, order, key, doc
            trim()
            yield _rows(told)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch and part one row of the sums of its documents, to the batch's home."""
        parts_of: dict[int, dict[bytes, list[Reader]]] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                parts_of.setdefault(part, {}).setdefault(blob[:1], []).append(Reader(blob, 1))
        while parts_of:
            kinds = parts_of.popitem()[1]
            keys, values, words = _taken(kinds.pop(b"E", None), np.uint64, np.int64)
            values = _unfixed(values)
            order, cut = distinct(keys)  # a state and a transition have one key
            keys, values, words = Table(keys[order][cut]), np.add.reduceat(values[order], cut) if len(cut) else values, words[order][cut] > 0
            del order, cut
            trim()
            out = [(int(r.take()[0]), r.raw) for r in kinds.pop(b"D", [])]
            asks = kinds.pop(b"A", [])
            while asks:  # each goes when it is answered
                r = asks.pop()
                key, n, doc, home, name = r.take_sorted(), r.counts(), take_small(r), r.take(), r.take()
                place, hit = keys.find(key)
                place, hit = np.repeat(place, n), np.repeat(hit, n)
                place, doc = place[hit], doc[hit]
                told, value, word = np.flatnonzero(np.bincount(doc, minlength=int(name[2]))), values[place], words[place]
                known, base, full = np.bincount(doc[word], minlength=int(name[2])), np.bincount(doc[word], value[word], int(name[2])), np.bincount(doc, value, int(name[2]))
                out.append((int(home[0]), b"".join([b"S", pack(name), pack(told), *(pack(x[told].astype(np.float64)) for x in (known, base, full))])))
            for k in range(0, len(out), 1000):
                yield _rows(out[k : k + 1000])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Reader] = {}
        sums: dict[int, list] = {}
        for b in batches:
            for blob in b.column("blob").to_pylist():
                r = Reader(blob, 1)
                if blob[:1] == b"D":
                    r.take()
                name = r.take()
                held = sums.setdefault(int(name[0]), [name, 0, np.zeros((3, int(name[2])))])
                if (held[0] != name).any():
                    raise RuntimeError("the texts came in another order when a lost task ran again")
                if blob[:1] == b"D":
                    asked[int(name[0])] = r
                else:
                    held[1] += 1
                    at = r.take().view(np.int64)
                    for row in held[2]:
                        row[at] += r.floats()
        for batch, r in asked.items():
            _, n, (words, base, full) = sums[batch]
            if n != r.counts()[0]:
                raise RuntimeError("look-ups were lost: the texts came in another order when a lost task ran again")
            ids, unnamed, size, known = (r.counts() for _ in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, unnamed, size, known + np.rint(words).astype(np.int64), r.floats() + base, r.floats() + full)], ["doc", "unnamed", "tokens", "known", "base", "full"])

    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("doc_id").isNull().cast("long").alias("unnamed"), "text")
    def scored(k: int) -> DataFrame:
        some = keyed if rounds == 1 else keyed.filter(F.pmod(F.xxhash64("doc"), F.lit(rounds)) == k)
        asked = some.mapInArrow(ask, _BLOB).unionAll(rest(parts))
        answered = asked.repartitionById(parts, F.col("part")).mapInArrow(answer, _BLOB)
        return answered.repartitionById(homes, F.col("part")).mapInArrow(finish, "doc long, unnamed long, tokens long, known long, base double, full double")

    sweep(spark)
    each = reduce(DataFrame.unionAll, [*(stored(scored(k), f"scores-{k}") for k in range(rounds - 1)), scored(rounds - 1)])
    each = each.withColumn("doc_id", F.when(F.col("unnamed") == 0, F.col("doc")))
    return each.select("doc_id", held_out("doc_id", *hold).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("full").alias("score"))
