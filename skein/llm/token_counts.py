"""Token counts: batch encoding in Arrow functions that return lengths only.

A byte-level BPE never merges across its pre-tokens, and a pre-token never runs over a single space between
two characters that are not white space. Such spaces are the safe boundaries at which texts of any length are
split: the count of a text is the sum of its pieces' counts. Pieces recur, so each Python worker keeps the
counts of the pieces it has met in a table of bounded size, and encodes only the others, in batches balanced
by bytes. No shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.text import pair, slices, small_batches

#: The count table of a worker is emptied when it holds so many pieces; longer pieces are never kept.
TABLE, LONGEST = 400_000, 40
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at its safe spaces; joined by spaces they are the text again. All but the first stand for a space and themselves."""
    parts = text.split(" ")
    if all(x and not x[0].isspace() and not x[-1].isspace() for x in {*parts}):
        return parts
    return _SAFE.split(text)


class Counter:
    """Counts tokens of texts with a ``tokenizers`` file."""

    def __init__(self, path: str, batch_bytes: int):
        from tokenizers import Tokenizer

        #: Of a piece after a space, its count together with the space.
        self.tokenizer, self.batch_bytes, self.table = Tokenizer.from_file(path), batch_bytes, {}

    def encode(self, new: list[str]) -> list[int]:
        """Token counts of pieces, encoded in batches of about equal bytes."""
        out, batch, held = [], [], 0
        for x in new:
            batch.append(x)
            held += len(x) if x.isascii() else len(x.encode())
            if held >= self.batch_bytes:
                out += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, held = [], 0
        return out + ([len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)] if batch else [])

    def count(self, texts: list[str]) -> list[int]:
        if len(self.table) > TABLE:
            self.table.clear()
        table, cut = self.table, [pieces(x) for x in texts]
        heads = self.encode([parts[0] for parts in cut])
        new = list({*(x for parts in cut for x in parts[1:])} - table.keys())
        fresh = dict(zip(new, self.encode([" " + x for x in new]), strict=True))
        long = {k for k in new if len(k) > LONGEST}
        table.update(fresh)
        out = [head + sum(map(table.__getitem__, parts[1:])) for head, parts in zip(heads, cut, strict=True)]
        for k in long:
            del table[k]
        return out


def token_counts(docs: DataFrame, path: str | None = None, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    A null or empty text has no bytes and no tokens; repeated rows are counted each; a null id stays null; other
    columns of ``docs`` play no part. ``path``: the vocabulary file, by default ``name`` of ``public_tokenizers``
    on the executor. A special token's string inside a text counts as the library takes it by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path(name)
        counter = Counter(where, batch_bytes)
        for b in slices(batches):
            rows = [x or "" for x in b.column("text").to_pylist()]
            tokens = np.array(counter.count(rows), np.int64)
            size = [len(x) if x.isascii() else len(x.encode()) for x in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return pair(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
