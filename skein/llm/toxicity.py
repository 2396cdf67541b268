"""Toxicity by two class-conditional Kneser-Ney models of expressions.

An expression is a word, spelt in bytes between its bounds; each class has an interpolated Kneser-Ney model of the bytes
given up to ``ORDER`` - 1 bytes before, so an unseen inflection of a known stem is judged by the stem. Both classes
learn from equally many labelled texts, and a word counts as often as it has distinct words before it, so copies weigh
little. Orders above ``SHARED`` have counts of their class; rare contexts fall back, by absolute discounting, to
continuation counts and at last to lower orders that both classes share. A text's toxic and ordinary log-likelihoods are
compared per word, over all of it and over its most toxic run of ``RUN`` words; a logistic curve, fitted on texts that
the models didn't see, turns both into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.packing import trim
from skein.llm.text import hash_words, held_out, inside, mix, pair, slices, small_batches, texts
from skein.llm.training import labelled_texts

ORDER, SHARED, DISCOUNT, RUN = 5, 2, 1.0, 2
#: A worker's table of words is emptied when it holds so many.
TABLE = 300_000
#: Bytes of texts that are split into words at a time: every word is an object, every byte of a new word a row of numbers.
_BATCH = 1 << 20
#: A-Z to lower case, other ASCII but digits to spaces, longer characters as they are.
CLEAN = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or 97 <= c < 123 or 48 <= c < 58 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased."""
    return text.translate(CLEAN).split()


def _weights(rows: list[bytes]) -> dict[bytes, float]:
    """Every word of the texts with its number of distinct words before it."""
    words = [words_of(x) for x in rows]
    flat = [w for x in words for w in x]
    if not flat:
        return {}
    starts = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    h = hash_words([b" ".join(flat)])[0]
    first = np.ones(len(flat), bool)
    if len(flat) > 1:
        with np.errstate(over="ignore"):
            pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        pairs = np.where(inside(starts, 2, len(h)), pairs, h[1:])
        first[1:] = False
        first[1:][np.unique(pairs, return_index=True)[1]] = True
    out: dict[bytes, float] = {}
    for k in np.flatnonzero(first):
        out[flat[k]] = out.get(flat[k], 0.0) + 1
    return out


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ' word word ... ', for each its distance from the bound before it, and its word's number."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    bound = np.flatnonzero(flat == 32)
    size = np.diff(bound)
    far = np.arange(1, len(flat)) - np.repeat(bound[:-1], size)
    return flat, np.concatenate([[0], far]), np.concatenate([[0], np.repeat(np.arange(len(words)), size)])


def _keys(flat: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes up to each place as one number, tagged with k; the first k - 1 places mean nothing."""
    out = np.zeros(len(flat), np.uint64)
    for t in range(k):
        out[t:] |= flat[: len(flat) - t] << np.uint64(8 * t)
    return out | np.uint64(k << 60)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inv = np.unique(keys, return_inverse=True)
    return found, np.bincount(inv, weights, len(found))


@dataclass
class Level:
    """One order: discounted mass of grams, and the weight that contexts leave to the order below, in each class."""

    grams: np.ndarray
    mass: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


def _level(flat, far, weight, k: int, classes: int) -> Level:
    """weight: classes x places. Grams that start at a bound, or of the top order, have their words' counts; others count
    the distinct bytes before them."""
    at = np.flatnonzero(far >= max(k - 1, 1))
    key, bound = _keys(flat, k)[at], far[at] == k - 1
    grams = np.unique(key)
    place = np.searchsorted(grams, key)
    n = np.zeros((classes, len(grams)))
    for c in range(classes):
        w = weight[c][at]
        raw = bound | (k == ORDER)
        n[c] = np.bincount(place[raw], w[raw], len(grams))
        rest = ~raw & (w > 0)
        longer = _keys(flat, k + 1)[at][rest]
        once = np.unique(longer, return_index=True)[1]
        n[c] += np.bincount(place[rest][once], minlength=len(grams))
    before = _shorter(grams, k)
    contexts, of = np.unique(before, return_inverse=True)
    whole = np.array([np.bincount(of, x, len(contexts)) for x in n])
    gone = np.array([np.bincount(of, np.minimum(x, DISCOUNT), len(contexts)) for x in n])
    back = np.where(whole > 0, gone / np.maximum(whole, 1e-9), 1.0)
    mass = np.maximum(n - DISCOUNT, 0) / np.maximum(whole[:, of], 1e-9)
    kept, open_ = (mass > 0).any(0), (back < 1).any(0)
    return Level(grams[kept], mass[:, kept], contexts[open_], back[:, open_])


def _shorter(keys: np.ndarray, k: int) -> np.ndarray:
    """The context of grams of order k: all but the last byte."""
    low = np.uint64((1 << 60) - 1)
    return ((keys & low) >> np.uint64(8)) | np.uint64((k - 1) << 60)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return place, (keys[place] == wanted) if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    levels: list[Level]
    curve: tuple = (0.0, 1.0, 0.0)
    table: dict[bytes, float] = field(default_factory=dict)

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """log10 P(word | toxic) / P(word | ordinary) of words."""
        flat, far, of = _spelt(words)
        p = np.full((2, len(flat)), 1 / 256)
        for k, level in enumerate(self.levels, 1):
            ok = np.flatnonzero(far >= max(k - 1, 1))
            key = _keys(flat, k)[ok]
            place, hit = _at(level.contexts, _shorter(key, k))
            seen, place = ok[hit], place[hit]
            grams, there = _at(level.grams, key[hit])
            two = slice(None) if len(level.mass) == 2 else [0, 0]
            mass = np.where(there, level.mass[:, grams] if len(level.grams) else 0.0, 0.0)[two]
            p[:, seen] = mass + level.back[:, place][two] * p[:, seen]
        log = np.log10(p[0]) - np.log10(p[1])
        return np.bincount(of[1:], log[1:], len(words))

    def features(self, rows: list[bytes]) -> np.ndarray:
        """Per text: mean log ratio of all words, and of the most toxic run; 0 for texts without words."""
        words = [words_of(x) for x in rows]
        if len(self.table) > TABLE:
            self.table.clear()
        new = list({w for x in words for w in x} - self.table.keys())
        if new:
            self.table.update(zip(new, self.ratios(new).tolist(), strict=True))
        out = np.zeros((len(rows), 2))
        for k, x in enumerate(words):
            if x:
                total = np.cumsum(np.fromiter(map(self.table.__getitem__, x), float, len(x)))
                run = min(RUN, len(x))
                best = total[run - 1 :].copy()
                best[1:] -= total[:-run]
                out[k] = total[-1] / len(x), best.max() / run
        return out

    def score(self, rows: list[bytes]) -> np.ndarray:
        b, *w = self.curve
        return 1 / (1 + np.exp(-np.clip(b + self.features(rows) @ np.array(w), -35, 35)))


def fit_model(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    counts = [_weights(toxic), _weights(ordinary)]
    words = sorted(counts[0].keys() | counts[1].keys())
    flat, far, of = _spelt(words)
    weight = np.array([[c.get(w, 0.0) for w in words] for c in counts])
    each = weight[:, of]
    return Model([_level(flat, far, each.sum(0, keepdims=True) if k <= SHARED else each, k, 1 if k <= SHARED else 2) for k in range(1, ORDER + 1)])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple:
    """Newton's method; intercept first. The classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (each * (p - y)) + l2 * w
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(rows: list[tuple[int, bytes, int]]) -> Model | None:
    """The models of all rows, with a curve from texts left out in turn; None unless both classes have 4 texts with words."""
    rows = list({text: (i, text, y) for i, text, y in rows if words_of(text)}.values())
    sides = [[t for _, t, y in rows if y == k] for k in (1, 0)]
    few = min(map(len, sides))
    if few < 4:
        return None
    toxic, ordinary = (x[:few] for x in sides)
    seen, ys = [], []
    for fold in (0, 1):
        half = fit_model(toxic[fold::2], ordinary[fold::2])
        for y, side in ((1, toxic[1 - fold :: 2]), (0, ordinary[1 - fold :: 2] + sides[1][few : 2 * few])):
            seen.append(half.features(side))
            ys.append(np.full(len(side), y))
    model = fit_model(toxic, ordinary)
    model.curve = logistic(np.concatenate(seen), np.concatenate(ys).astype(float))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 1000, hold: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0..1), predicted (1 if score >= threshold) of every row.

    Learns from at most ``per_class`` labelled texts a class, none of them with crc32(id) mod hold[0] = hold[1]; the
    model is of bounded size and broadcast. Null and empty texts are scored by the curve's start, as texts without
    evidence; without labels of both classes every score is 0. Repeated rows score alike; the id, null or not, and other columns
    are never inputs of a score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_texts(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), labels, "toxic", per_class, hold)
    model = spark.sparkContext.broadcast(fit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches, limit=_BATCH):
            rows = texts(b)
            score = m.score(rows) if m else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        trim()

    rows = pair(docs, id_col, text_col)
    return rows.withColumn("held_out", held_out("doc_id", *hold)).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 1000, hold: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose score is below the threshold; scores and their cases are those of score_toxicity."""
    small_batches(docs.sparkSession)
    sample = labelled_texts(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), labels, "toxic", per_class, hold)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches, by=text_col, limit=_BATCH):
            yield b.filter(pa.array(m.score(texts(b, text_col)) < threshold)) if m else b
        trim()

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
