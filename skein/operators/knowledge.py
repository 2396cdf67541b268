"""Concepts of texts without a model, checks of references, and hashes of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concepts(text: Column, most: int = 8) -> Column:
    """The first ``most`` distinct words of three or more ASCII letters and digits, sorted; none for a null text. Texts are chunks
    (``search.chunks``): a long document has the concepts of each of its chunks."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 3), F.lower))), 1, most)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, confidence of each text's concepts; a text without any has the entity ``text`` of confidence 0.1."""
    found = docs.select(F.col(id_col).alias("id"), concepts(F.col(text_col)).alias("c"))
    none = F.size("c") == 0
    labels = F.when(none, F.array(F.lit("text"))).otherwise(F.col("c"))
    return found.select("id", F.explode(labels).alias("label"), F.when(none, 0.1).otherwise(0.5).alias("confidence"))


def relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, from_label, to_label: each concept of a text with the next."""
    found = docs.select(F.col(id_col).alias("id"), concepts(F.col(text_col)).alias("c")).filter(F.size("c") > 1)
    pairs = F.arrays_zip(F.slice("c", 1, 7).alias("from_label"), F.slice("c", 2, 7).alias("to_label"))
    return found.select("id", F.inline(pairs)).filter("to_label is not null").toDF("id", "from_label", "to_label")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id, kind, missing: the ends of edges that aren't nodes; empty when the references hold."""
    out = None
    for end in ("from_id", "to_id"):
        gone = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti").select("from_id", "to_id", "kind", F.col(end).alias("missing"))
        out = gone if out is None else out.unionAll(gone)
    return out.distinct()


def snapshot_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and digest (decimal text) of a table: equal for equal rows in any order, with repeats; one partial sum a task."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("digest"))
