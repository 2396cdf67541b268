"""Bounded, repeatable samples of labelled texts for the classifiers that are fitted on the driver."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.text import held_out, pair


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, hold: tuple[int, int] | None = None, max_bytes: int = 1 << 18, total_bytes: int = 64 << 20) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, label 0 or 1), at most ``per_class`` of each label: those with the least hash of their id.

    ``hold`` (modulus, remainder): ids whose crc32 leaves the remainder are not taken. Of a document's several labels the
    largest counts; null labels and ids are no labels. Of an id's several texts the one with the least hash counts, whatever
    the order of rows. Texts above ``max_bytes`` are not taken for training, nor, in the order of the ids' hashes, what goes
    beyond ``total_bytes``. At most 2 * per_class ids are broadcast, and texts of ``total_bytes`` collected.
    """
    worst = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    if hold:
        worst = worst.filter(~held_out("doc_id", *hold))
    ids = [r for y in (0, 1) for r in worst.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return []
    spark, label = docs.sparkSession, {r.doc_id: r.label for r in ids}

    def rows(chosen: list[int]) -> DataFrame:
        wanted = spark.createDataFrame(pa.table({"doc_id": pa.array(chosen, pa.int64())}))  # lists of rows would start workers of their own
        return pair(docs, "doc_id", "text").join(F.broadcast(wanted), "doc_id").filter(F.octet_length("text") <= max_bytes)

    first = rows([*label]).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))).alias("one"))
    sizes = {r.doc_id: (r.one["hash"], r.one["size"]) for r in first.collect()}
    held, chosen = 0, []
    for r in sorted(ids, key=lambda r: zlib.crc32(str(r.doc_id).encode())):  # both labels alike
        if r.doc_id in sizes and held + sizes[r.doc_id][1] <= total_bytes:
            held += sizes[r.doc_id][1]
            chosen.append(r.doc_id)
    if not chosen:
        return []
    one = spark.createDataFrame(pa.table({"one_id": pa.array(chosen, pa.int64()), "one_hash": pa.array([sizes[i][0] for i in chosen], pa.int64())}))
    found = rows(chosen).join(F.broadcast(one), (F.col("doc_id") == F.col("one_id")) & (F.xxhash64("text") == F.col("one_hash"))).groupBy("doc_id").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.text.encode(), label[r.doc_id]) for r in found.collect())
