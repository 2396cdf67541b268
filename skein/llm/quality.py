"""Quality rules: counts that rules judge, and a logistic regression over hashed word and character n-grams.

The regression learns from a bounded sample of labelled rows on the driver, is calibrated on texts it didn't learn from,
and scores whole texts in Arrow batches against a fixed threshold. No shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.text import doc_of, grams, hash_words, inside, mix, pair, slices, texts
from skein.llm.training import labelled_texts

#: Bits of a feature's hash; two tables, of words with word pairs and of byte 3-grams.
BITS = 16
WINDOW = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that begin a code point inside a word; and the rule's symbols.
_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & ~_SPACE
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between starts."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def repeated(hashes: np.ndarray, starts: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Of each word, whether it lies in an n-word window that its text holds twice or more."""
    out = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= n:
        at = np.flatnonzero(inside(starts, n, len(hashes)))
        with np.errstate(over="ignore"):
            keys = mix(grams(hashes, n)[at] + doc_of(starts)[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inv, n_found = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[n_found[inv] > 1]
        np.add.at(out, twice, 1)
        np.add.at(out, twice + n, -1)
    return np.cumsum(out)[:-1] > 0


def counts(rows: list[bytes]) -> tuple[dict[str, np.ndarray], tuple]:
    """The rules' counts of each text, and the words' hashes with their starts."""
    hashes, starts = hash_words(rows)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    dup = []
    for x in rows:
        lines = [s for s in x.split(b"\n") if s.strip()] if b"\n" in x else ()
        dup.append(len(lines) - len({*lines}))
    found = {
        "n_words": np.diff(starts),
        "word_chars": _per_text(_CHAR[flat], ends),
        "n_symbols": _per_text(_SYMBOL[flat], ends),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": _per_text(repeated(hashes, starts), starts),
    }
    return found, (flat, ends, hashes, starts)


def _features(flat, ends, hashes, starts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two lists of (bin of each occurrence, number of its text): words and word pairs; byte 3-grams."""
    low = np.uint64((1 << BITS) - 1)
    of = doc_of(starts)
    two = np.flatnonzero(inside(starts, 2, len(hashes)))
    words = np.concatenate([mix(hashes) & low, grams(hashes, 2, 7)[two] & low])
    three = np.flatnonzero(inside(ends, 3, len(flat)))
    wide = flat.astype(np.uint32)
    code = (wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) if len(flat) > 2 else wide[:0]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return [(words.astype(np.int64), np.concatenate([of, of[two]])), (code[three].astype(np.int64), doc_of(ends)[three])]


@dataclass
class Scorer:
    weights: list[np.ndarray]
    bias: float
    curve: tuple[float, float] = (0.0, 1.0)

    def margin(self, parts, n: int) -> np.ndarray:
        """The mean weight of a text's features, summed over the two tables."""
        out = np.full(n, self.bias)
        for w, (bins, of) in zip(self.weights, parts, strict=True):
            out += np.bincount(of, w[bins], n) / np.maximum(np.bincount(of, minlength=n), 1)
        return out

    def probability(self, parts, n: int) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.margin(parts, n), -35, 35)))


def _rows(parts, n: int) -> list[tuple]:
    """Each table as sparse rows: text, bin, part of the text's features."""
    out = []
    for bins, of in parts:
        key, k = np.unique(of * np.int64(1 << BITS) + bins, return_counts=True)
        text = key >> BITS
        out.append((text, key & ((1 << BITS) - 1), k / np.bincount(of, minlength=n)[text]))
    return out


def _descend(sparse, y: np.ndarray, rounds: int = 60, rate: float = 4.0, l2: float = 1e-6) -> Scorer:
    """Logistic regression by full-batch Adagrad; the classes weigh alike."""
    n = len(y)
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, seen, b = [np.zeros(1 << BITS) for _ in sparse], [np.full(1 << BITS, 1e-10) for _ in sparse], 0.0
    for _ in range(rounds):
        m = np.full(n, b) + sum(np.bincount(t, v * x[f], n) for (t, f, v), x in zip(sparse, w, strict=True))
        g = each * (1 / (1 + np.exp(-np.clip(m, -35, 35))) - y)
        for (t, f, v), x, s in zip(sparse, w, seen, strict=True):
            step = np.bincount(f, v * g[t], 1 << BITS) + l2 * x
            s += step * step
            x -= rate * step / np.sqrt(s)
        b -= 0.5 * g.sum()
    return Scorer(w, b)


def fit(rows: list[tuple[int, bytes, int]]) -> Scorer | None:
    """Learns from four fifths of the distinct texts, calibrates on the others; None unless both classes have 5 texts."""
    from skein.llm.toxicity import logistic

    rows = list({text: (text, y) for _, text, y in rows if text.split()}.values())
    y = np.array([v for _, v in rows], float)
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return None
    part = np.zeros(len(y), bool)
    for k in (0, 1):
        part[np.flatnonzero(y == k)[::5]] = True
    take = lambda mask: [t for (t, _), m in zip(rows, mask, strict=True) if m]
    learnt = take(~part)
    scorer = _descend(_rows(_features(*counts(learnt)[1]), len(learnt)), y[~part])
    rest = take(part)
    scorer.curve = logistic(scorer.margin(_features(*counts(rest)[1]), len(rest))[:, None], y[part], l2=1e-2)
    return scorer


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500, min_words: int = 10, max_repeated: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept of every row.

    base_failed: fewer than ``min_words`` words, or over ``max_repeated`` percent of them in repeated 5-word windows.
    kept: not failed, and the calibrated probability of quality 1 is at least ``threshold``. At most ``per_class``
    labelled texts a class are learnt from; without both classes quality is null and the rules alone decide. Null texts
    have no words; repeated rows are judged each; ids may be null; other columns play no part.
    """
    spark = docs.sparkSession
    sample = labelled_texts(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), labels, "quality", per_class)
    model = spark.sparkContext.broadcast(fit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        for b in slices(batches, limit=2 << 20):
            rows = texts(b)
            found, parts = counts(rows)
            failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > max_repeated * found["n_words"])
            q = scorer.probability(_features(*parts), len(rows)) if scorer else np.full(len(rows), np.nan)
            kept = ~failed & ~(q < threshold)
            cols = [pa.array(v.astype(np.int64)) for v in found.values()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(failed), pa.array(q, from_pandas=True), pa.array(kept)], ["doc_id", *found, "base_failed", "quality", "kept"])

    return pair(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean")
