"""Decisions kept as a Markdown table: their rows, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.symbols import on_cycles

#: The table's columns, in order (fixed values).
COLUMNS = ["id", "status", "date", "decision", "source", "anchors", "supersedes", "related"]
STATUSES = ["proposed", "accepted", "rejected", "superseded"]


def _listed(cell: Column) -> Column:
    return F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-"))


def decisions(lines: DataFrame) -> DataFrame:
    """doc_id, line_no and the table's columns; anchors, supersedes and related as arrays. ``lines`` has doc_id, line_no, line.

    Rows are the lines of eight cells after the first header of a document; the separator and other lines are left out.
    Empty cells and ``-`` are null; a document without the header has no rows.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.filter(F.col("line").contains("|")).select("doc_id", "line_no", cells.alias("c")).filter(F.size("c") == len(COLUMNS))
    head = F.transform("c", F.lower) == F.array(*[F.lit(c) for c in COLUMNS])
    first = F.min(F.when(head, F.col("line_no"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("head", first).filter((F.col("line_no") > F.col("head")) & ~F.forall("c", lambda x: x.rlike("^:?-{3,}:?$")))
    plain = [F.when(~F.col("c")[k].isin("", "-"), F.col("c")[k]).alias(n) for k, n in enumerate(COLUMNS[:5])]
    return rows.select("doc_id", "line_no", *plain, *[_listed(F.col("c")[k]).alias(n) for k, n in enumerate(COLUMNS[5:], 5)])


def faults(rows: DataFrame) -> DataFrame:
    """id, fault of decisions (of one document): bad_id, bad_status, bad_date, no_decision, duplicate, missing (of a reference),
    may_not_supersede, target_not_superseded, superseded_by_none and cycle. No rows if all is well."""
    own = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "bad_id"),
        F.when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "bad_status"),
        F.when(~F.coalesce(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False)), "bad_date"),
        F.when(F.col("decision").isNull(), "no_decision"),
        F.when(F.col("status").isin("proposed", "rejected") & (F.size("supersedes") > 0), "may_not_supersede"),
    ))
    out = rows.select("id", F.explode(own).alias("fault"))
    twice = rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = rows.select(F.col("id").alias("target"), F.col("status").alias("target_status")).dropDuplicates(["target"])
    links = rows.select("id", F.explode("supersedes").alias("target"))
    named = links.unionAll(rows.select("id", F.explode("related").alias("target")))
    old = rows.filter("status = 'superseded'").select("id").distinct()
    ring = on_cycles(links.select(F.col("id").alias("from_id"), F.col("target").alias("to_id")))
    for found, fault in (
        (twice.select("id"), "duplicate"),
        (named.join(known, "target", "left_anti").select("id"), "missing"),
        (links.join(known, "target").filter("not target_status <=> 'superseded'").select("id"), "target_not_superseded"),
        (old.join(links.select(F.col("target").alias("id")), "id", "left_anti"), "superseded_by_none"),
        (ring, "cycle"),
    ):
        out = out.unionAll(found.select("id", F.lit(fault)))
    return out.distinct()
