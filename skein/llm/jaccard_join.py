"""N-gram Jaccard self-join of documents by chosen paths.

A set of word shingles is sent down paths of sampled tokens: at each step a token is chosen if a hash of path and token is below
a share of the set's size, the same hash for all sets, so that similar sets choose the same tokens. Sets at the end
of one path form a bucket; buckets that are too large are split by another step, small ones are brute-forced. The whole is repeated,
with other hashes, until the chance that a pair at the threshold never meets, even if its buckets are too large at every step but
the last, is below 1 - recall. A large bucket's sets are first compared with its least set, the leader: those alike are its
candidates, and those nearly equal go no further, since whatever is linked with them is alike the leader too. So a group of
near copies ends there, and what is split on are sets that met by a common passage.

Copies (equal sets) are one set throughout. In a bucket sets are compared by sketches of 64 one-byte minima, far
below the threshold, only to drop sets that meet by a common passage; what is left are candidate groups. Sets in buckets that
are still too large after the last step meet by their rarest tokens, so many that none of their links is lost. Every pair
within a group is then compared in full, groups of many sets in blocks, so links that the buckets missed within a group
are found as well. Pairs are counted where they are compared and never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.components import components
from skein.functions.durable import durable, sweep
from skein.llm.packing import trim
from skein.llm.text import doc_of, grams, hash_words, inside, mix, slices, small_batches, texts

#: Words of a shingle, least similarity, share of linked pairs that must meet.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99
#: Expected tokens that a set chooses at the first and at each later step.
FIRST, LATER = 2.5, 1.7
#: Sets of a bucket above which it is split again, and steps at most.
LARGE, STEPS = 2048, 4
#: Sketch minima, and how many of them must agree: 64 * 0.8 less five standard deviations. Sets of which so many agree with
#: a leader's (similarity about 0.9) end at it: at 0.8 from them a set is at 0.7 or more from the leader.
SKETCH, AGREE, NEAR = 64, 35, 58
#: Sets, about, whose tokens are counted where buckets stay large, and tokens of known count that are broadcast, at most.
SAMPLE, OFTEN = 20_000, 200_000
#: Sets of a candidate group that are compared in one block, and ids that are broadcast at most.
BLOCK, BROADCAST = 128, 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are split at a time.
_BATCH = 1 << 20


def runs_for(recall: float, similarity: float = SIMILARITY, steps: int = STEPS) -> int:
    """Repeats so that two sets of at least this similarity meet in a last bucket with probability ``recall``, though all buckets
    before it are split.

    The worst case is a subset: then the larger set of n tokens has similarity * n in common, of which each is chosen by
    both with probability FIRST / n, LATER / n. Common paths branch; the chance that none is left after each step is
    that of a Poisson number of them all dying out.
    """
    lost = 0.0
    for _ in range(steps - 1):
        lost = exp(-LATER * similarity * (1 - lost))
    return ceil(log(1 - recall) / log(exp(-FIRST * similarity * (1 - lost))))


def shingles(rows: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text in a row, and where each text starts. A text of fewer words is one shingle."""
    h, starts = hash_words(rows)
    g = grams(h, words)
    at = np.flatnonzero(inside(starts, words, len(h)))
    of, val = doc_of(starts)[at], g[at]
    short = np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < words))
    extra = np.array([xxhash.xxh3_64_intdigest(h[starts[k] : starts[k + 1]].tobytes()) for k in short], np.uint64)
    of, val = np.concatenate([of, short]), np.concatenate([val, extra])
    order = np.lexsort((val, of))
    of, val = of[order], val[order]
    new = np.concatenate([[True], (val[1:] != val[:-1]) | (of[1:] != of[:-1])]) if len(val) else np.zeros(0, bool)
    of, val = of[new], val[new]
    return val, np.searchsorted(of, np.arange(len(rows) + 1))


def step(tokens: np.ndarray, size: np.ndarray, path: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are chosen after a path (or a run's seed), and the longer paths. ``size``: of each token's set."""
    with np.errstate(over="ignore"):
        u = mix(tokens * _ODD ^ mix(path))
        chosen = np.flatnonzero((u >> np.uint64(11)).astype(float) * 2.0**-53 * size < branch)
        path = path[chosen] if path.ndim else np.repeat(path, len(chosen))
        return chosen, mix(u[chosen] + path)


def _seed(run: int) -> np.ndarray:
    return mix(np.array(run + 1, np.uint64) * _ODD)


def paths(val: np.ndarray, starts: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, path) of every set after the first step."""
    size, of = np.diff(starts), doc_of(starts)
    who, out = [], []
    for r in range(runs):
        at, path = step(val, size[of], _seed(r), FIRST)
        who.append(of[at])
        out.append(path)
    return np.concatenate(who), np.concatenate(out)


def longer(val: np.ndarray, starts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set number, path) of every set one step after each of its paths in ``held``."""
    who, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for d, some in enumerate(held):
        t = val[starts[d] : starts[d + 1]]
        for p in some:
            _, path = step(t, np.full(len(t), len(t)), np.full(len(t), p, np.uint64), LATER)
            who.append(np.full(len(path), d))
            out.append(path)
    return np.concatenate(who), np.concatenate(out)


def sketches(val: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One byte of the least token under each of SKETCH hashes; zeros for empty sets."""
    n = len(starts) - 1
    out = np.zeros((n, SKETCH), np.uint8)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        with np.errstate(over="ignore"):
            low = (val >> np.uint64(32)).astype(np.uint32)
            for k in range(SKETCH):
                u = (val.astype(np.uint32) ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32((k * 2 + 1) * 0x9E3779B1 & 0xFFFFFFFF) + low
                u = (u ^ (u >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                u ^= u >> np.uint32(13)
                least = np.minimum.reduceat(u, starts[:-1][full])
                out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _stars(linked, n: int) -> list[tuple[int, int]]:
    """(least member, other member) of each group of more than one; ``linked(i, rest)``: which of rest are linked with i."""
    rest, out = np.arange(n), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            hit = linked(queue.pop(), rest)
            found, rest = rest[hit], rest[~hit]
            queue += found.tolist()
            out += [(int(root), int(x)) for x in found]
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the sets that look alike in each bucket; rows come in order of (path, block)."""

    def told(path, key, sketch) -> pa.RecordBatch | None:
        u, v = [], []
        cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]).any(1), [True]]))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[((sketch[two] == sketch[two + 1]).sum(1) >= AGREE) & (key[two] != key[two + 1])]
        u += np.minimum(key[two], key[two + 1]).tolist()
        v += np.maximum(key[two], key[two + 1]).tolist()
        for s, e in zip(cut[:-1][size > 2].tolist(), cut[1:][size > 2].tolist(), strict=True):
            k, first = np.unique(key[s:e], return_index=True)
            m = sketch[s:e][first]
            for a, b in _stars(lambda i, rest, m=m: (m[rest] == m[i]).sum(1) >= AGREE, len(k)):
                u.append(int(k[a]))
                v.append(int(k[b]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]) if u else None

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        path = np.stack([np.asarray(b.column("path")), np.asarray(b.column("block"))], 1)
        sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        rows = (path, np.asarray(b.column("set_key")), sketch)
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        last = np.flatnonzero((rows[0] != rows[0][-1]).any(1))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole and (out := told(*(x[:whole] for x in rows))):
            yield out
        held = tuple(x[whole:] for x in rows)
    if held is not None and (out := told(*held)):
        yield out


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set on a large path with the number of its sketch minima that agree with the leader's."""
    for b in batches:
        if b.num_rows:
            mine, lead = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(-1, SKETCH) for x in ("sketch", "lead_sketch"))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("set_key", "sketch", "path", "lead")), pa.array((mine == lead).sum(1).astype(np.int32))], ["set_key", "sketch", "path", "lead", "agree"])


def _prefix(val: np.ndarray, starts: np.ndarray, t: Fraction, often: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set number, token) of the tokens by which sets of a similarity of ``t`` must meet: all but the last ceil(t * n) - 1 of a
    set's n tokens, in one order for all sets. Such sets have ceil(t * n) tokens of the larger one in common, so the first common
    token is among these, whatever the order; tokens that are often found come last."""
    of, n = doc_of(starts), np.diff(starts)
    place = np.minimum(np.searchsorted(often["token"], val), max(len(often["token"]) - 1, 0))
    count = np.where(often["token"][place] == val, often["n"][place], 0) if len(often["token"]) else np.zeros(len(val), np.int64)
    order = np.lexsort((mix(val), count, of))
    rank = np.arange(len(val)) - np.repeat(starts[:-1], n)
    on = order[rank < (n + (-t.numerator * n) // t.denominator + 1)[of]]
    return of[on], val[on]


def _by_prefix(keys: DataFrame, sets: DataFrame, docs: DataFrame, words: int, similarity: float, large: int) -> DataFrame:
    """(path, block, set_key, sketch) rows, by which any two of these sets that may be linked meet for certain.

    Sets meet by each token of their prefixes. How often tokens are found is counted in a sample, which decides their order alone.
    What more than ``large`` sets have in their prefixes is compared in pairs of blocks, every pair of sets.
    """
    spark, t = docs.sparkSession, Fraction(str(similarity))
    keys = durable(keys.join(sets.select("set_key", "sketch", F.col("first.doc_id").alias("rep_id"), F.col("first.text_key").alias("rep_text")), "set_key"))
    n_keys = keys.count()
    held = F.broadcast(keys) if n_keys <= BROADCAST // 4 else keys
    spelt = docs.join(held, (F.col("text_key") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("set_key", "sketch", "text").dropDuplicates(["set_key"])
    share = max(1, n_keys // SAMPLE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            token, n = np.unique(shingles(texts(b), words)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    sample = spelt.filter(F.pmod(F.xxhash64("set_key"), F.lit(share)) == 0)
    found = sample.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > max(1, large // (4 * share)))
    rows = found.orderBy(F.desc("n"), "token").limit(OFTEN).collect()
    token, n = np.array([r.token for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(token)
    often = spark.sparkContext.broadcast({"token": token[order], "n": n[order]})

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 18):  # each token goes with its set's sketch
            own, token = _prefix(*shingles(texts(b), words), t, often.value)
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([b.column("set_key").take(own), b.column("sketch").take(own), pa.array(token.view(np.int64))], ["set_key", "sketch", "path"])

    met = durable(spelt.mapInArrow(prefixes, "set_key long, sketch binary, path long"))
    size = met.groupBy(F.col("path").alias("of")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = met.join(size, F.col("path") == F.col("of")).withColumn("nb", F.ceil(F.col("k") / large))
    mine = F.pmod(F.xxhash64("set_key", "path"), F.col("nb"))
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    return met.select("path", F.shiftright(j * (j + 1), 1) + i, "set_key", "sketch").toDF("path", "block", "set_key", "sketch")


def candidate_groups(sets: DataFrame, docs: DataFrame, words: int, runs: int, large: int = LARGE, steps: int = STEPS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the sets that may be linked. ``sets``: set_key, paths, sketch, first (the row that spells the set)."""
    spark = docs.sparkSession
    level, parts, edges = sets.select("set_key", "sketch", F.explode("paths").alias("path")), [], []

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            val, starts = shingles(texts(b), words)
            own, path = longer(val, starts, [np.array(x, np.int64).view(np.uint64) for x in b.column("paths").to_pylist()])
            if len(own):
                found = np.unique(np.stack([own.astype(np.int64), path.view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([b.column("set_key").take(pa.array(found[:, 0])), b.column("sketch").take(pa.array(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], ["set_key", "sketch", "path"])

    for depth in range(1, steps + 1):
        top = F.min_by(F.struct("set_key", "sketch"), "set_key").alias("top")
        big = level.groupBy("path").agg(F.count(F.lit(1)).alias("k"), top).filter(F.col("k") > large)
        big = durable(big.select(F.col("path").alias("large"), F.col("top.set_key").alias("lead"), F.col("top.sketch").alias("lead_sketch")))
        n_big = big.count()
        if not n_big:
            parts.append(level.select("path", F.lit(0).cast("long").alias("block"), "set_key", "sketch"))
            break
        held = F.broadcast(big) if n_big <= BROADCAST // 4 else big
        told = level.join(held, F.col("path") == F.col("large"), "left")
        parts.append(told.filter("large is null").select("path", F.lit(0).cast("long").alias("block"), "set_key", "sketch"))
        led = told.filter("large is not null").select("set_key", "sketch", "path", "lead", "lead_sketch")
        led = durable(led.mapInArrow(_led, "set_key long, sketch binary, path long, lead long, agree int"))
        edges.append(led.filter((F.col("agree") >= AGREE) & (F.col("lead") != F.col("set_key"))).select(F.least("lead", "set_key").alias("u"), F.greatest("lead", "set_key").alias("v")))
        on = led.filter(F.col("agree") < NEAR)
        if depth == steps:  # what the steps haven't told apart meets by its rarest tokens
            parts.append(_by_prefix(on.select("set_key").distinct(), sets, docs, words, similarity, large))
            break
        on = on.groupBy("set_key").agg(F.collect_set("path").alias("paths"))
        on = durable(on.join(sets.select("set_key", "sketch", F.col("first.doc_id").alias("rep_id"), F.col("first.text_key").alias("rep_text")), "set_key"))
        on = F.broadcast(on) if on.count() <= BROADCAST // 4 else on
        spelt = docs.join(on, (F.col("text_key") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("set_key", "sketch", "paths", "text")
        level = durable(spelt.mapInArrow(whole, "set_key long, sketch binary, path long").dropDuplicates(["set_key", "path"]))
        sweep(spark)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = rows.repartition(n, "path", "block").sortWithinPartitions("path", "block").mapInArrow(_buckets, "u long, v long")
    for e in edges:
        found = found.unionAll(e)
    return components(found)


def _set_keys(val: np.ndarray, starts: np.ndarray) -> np.ndarray:
    raw = val.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(starts[:-1], starts[1:], strict=True)], np.uint64).view(np.int64)


def _compare(keys, copies, side, sets, t: Fraction):
    """Of a block's sets: links weighed by copies, and the least key of the sets that they reach."""
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), n)
    _, inv, k = np.unique(flat, return_inverse=True, return_counts=True)
    both = np.flatnonzero(k[inv] > 1)
    _, col = np.unique(inv[both], return_inverse=True)
    width = int(col.max(initial=-1)) + 1
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    cuts = np.searchsorted(col[order], np.arange(0, width + 8192, 8192))
    for c, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(sets), 8192), np.float32)
        part = order[s:e]
        m[of[both][part], col[part] - 8192 * c] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    linked = common * (t.numerator + t.denominator) >= t.numerator * (n[:, None] + n[None, :])
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    root = np.arange(len(sets))
    for a, b in _stars(lambda i, rest: linked[i][rest], len(sets)):
        root[b] = a
    return linked @ copies, keys[root]


def linked_sets(docs: DataFrame, sets: DataFrame, groups: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(set_key, links, root) rows of the sets in candidate groups: links found in one block, and the least set reached there."""
    spark = docs.sparkSession
    t = Fraction(str(similarity))
    size = groups.groupBy(F.col("component").alias("of")).agg(F.count(F.lit(1)).alias("m"))
    members = groups.join(size, F.col("component") == F.col("of")).join(sets.select("set_key", "first", "copies"), F.col("node") == F.col("set_key"))
    members = durable(members.select("set_key", "component", F.ceil(F.col("m") / block).cast("int").alias("nb"), F.col("first.doc_id").alias("rep_id"), F.col("first.text_key").alias("rep_text"), "copies"))
    narrow = F.broadcast(members) if members.count() <= BROADCAST else members
    rows = docs.join(narrow, (F.col("text_key") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("set_key", "component", "nb", "copies", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            val, starts = shingles(texts(b), words)
            raw = val.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("set_key", "component", "nb", "copies")), pa.array([raw[8 * s : 8 * e] for s, e in zip(starts[:-1], starts[1:], strict=True)], pa.binary())], ["set_key", "component", "nb", "copies", "tokens"])

    spelt = rows.mapInArrow(spell, "set_key long, component long, nb int, copies long, tokens binary")
    mine = F.pmod(F.xxhash64("set_key"), F.col("nb")).cast("int")
    dealt = spelt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set_key", "copies", "tokens")
    # a group's pairs of blocks go round the tasks in turn, from a task of the group's own
    turn = F.col("j").cast("long") * (F.col("j") + 1) / 2 + F.col("i")
    task = F.pmod(F.pmod(F.xxhash64("component"), F.lit(n)) + turn.cast("long"), F.lit(n)).cast("int")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            unique = list({r[4]: r for r in held}.values())
            if len(unique) < 2:
                return None
            unique.sort(key=lambda r: r[4])
            keys, copies = np.array([r[4] for r in unique]), np.array([r[5] for r in unique])
            side = np.array([r[3] == r[2] and r[1] != r[2] for r in unique])
            links, root = _compare(keys, copies, side, [np.frombuffer(r[6], np.uint64) for r in unique], t)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links.astype(np.int64)), pa.array(root)], ["set_key", "links", "root"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("component", "i", "j", "mine", "set_key", "copies", "tokens")), strict=True):
                if held and held[0][:3] != r[:3]:
                    if out := flush():
                        yield out
                    held = []
                held.append(r)
        if held and (out := flush()):
            yield out

    return dealt.repartitionById(n, task).sortWithinPartitions("component", "i", "j").mapInArrow(compare, "set_key long, links long, root long")


def _classified(docs: DataFrame, words: int, similarity: float, recall: float, large: int, steps: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, first (the class's first row), copies and links of the row's set; first is null for texts without words."""
    runs = runs_for(recall, similarity, steps)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=_BATCH):
            val, starts = shingles(texts(b), words)
            own, path = paths(val, starts, runs)
            found = np.unique(np.stack([own.astype(np.int64), path.view(np.int64)], 1), axis=0)
            cuts = np.searchsorted(found[:, 0], np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(np.ascontiguousarray(found[:, 1])))
            sketch = pa.array([x.tobytes() for x in sketches(val, starts)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(_set_keys(val, starts)), pa.array(np.diff(starts)), lists, sketch], ["doc_id", "text_key", "set_key", "size", "paths", "sketch"])
        trim()

    scanned = durable(rows.mapInArrow(scan, "doc_id long, text_key long, set_key long, size long, paths array<long>, sketch binary"))
    full = scanned.filter("size > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    sets = durable(full.groupBy("set_key").agg(first, F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")))
    groups = durable(candidate_groups(sets, rows, words, runs, large, steps, similarity))
    sweep(docs.sparkSession)
    # a file a task would be as many as there are partitions, and each starts two processes on a local file system
    found = durable(linked_sets(rows, sets, groups, words, similarity, block).hint("rebalance"))
    sweep(docs.sparkSession)
    links = found.groupBy(F.col("set_key").alias("linked")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("links > 0").select(F.col("root").alias("u"), F.col("set_key").alias("v")))
    named = sets.select("set_key", "first", "copies").join(classes, F.col("set_key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "set_key"))
    name = named.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("head"))
    told = named.join(name, F.col("component") == F.col("of")).join(links, F.col("set_key") == F.col("linked"), "left").select(F.col("set_key").alias("key"), "head", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    out = scanned.select("doc_id", "text_key", "set_key", "size").join(told, (F.col("set_key") == F.col("key")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "text_key", F.col("head").alias("first"), "copies", "links")


def jaccard_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, large: int = LARGE, steps: int = STEPS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least ``similarity``.
    class_id is the least doc_id that links lead to, n_links counts a row's linked rows, n_copies those with an equal set.
    A text of fewer words is one shingle; null texts and texts without words are linked with nothing and are classes of
    their own. Repeated rows are each other's copies. Null ids may be linked but name a class only if no other id does.
    """
    out = _classified(docs, words, similarity, recall, large, steps, block, id_col, text_col)
    class_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, large: int = LARGE, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, of which each is the first of its class: least id (null last), then least text hash.

    Of rows repeated in id and text one stays, even if the class has them first. Texts without words all stay.
    """
    told = durable(_classified(docs, words, similarity, recall, large, steps, BLOCK, id_col, text_col).select("doc_id", "text_key", "first"))
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    lost = told.filter(F.col("first").isNotNull() & ~mine).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_text"))
    lost = durable(lost.distinct())
    lost = F.broadcast(lost) if lost.count() <= BROADCAST else lost
    # the input's columns go as one, so that none of their names meets ours
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("row_id"), F.xxhash64(text).alias("row_key"))
    kept = rows.join(lost, F.col("row_id").eqNullSafe(F.col("lost_id")) & (F.col("row_key") == F.col("lost_text")), "left_anti")
    twice = told.filter(F.col("first").isNotNull()).filter(mine).groupBy(F.col("doc_id").alias("twice_id"), F.col("text_key").alias("twice_text")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        is_twice = F.col("row_id").eqNullSafe(F.col("twice_id")) & (F.col("row_key") == F.col("twice_text"))
        again = kept.join(twice, is_twice, "left_semi").dropDuplicates(["row_id", "row_key"])
        kept = kept.join(twice, is_twice, "left_anti").unionByName(again)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
