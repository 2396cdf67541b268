"""Filling a budget in order, without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.durable import durable


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their range partition and their row in it; together these give the order."""
    parted = durable(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    return durable(parted.withColumn("row_", F.row_number().over(Window.partitionBy("part_").orderBy(*order))))


def _earlier(rows: DataFrame, value) -> DataFrame:
    """before_: the sum of ``value`` over the earlier rows, in two steps; only one sum a range partition meets in one task."""
    rows = rows.withColumn("value_", value)
    sums = rows.groupBy("part_").agg(F.sum("value_").alias("sum_"))
    past = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part_", F.coalesce(F.sum("sum_").over(past), F.lit(0)).alias("offset_"))
    inner = Window.partitionBy("part_").orderBy("row_").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(offsets), "part_")
    return joined.withColumn("before_", F.col("offset_") + F.coalesce(F.sum("value_").over(inner), F.lit(0)))


def greedy_fill(rows: DataFrame, budget: int, order: list[str], size: str = "size") -> DataFrame:
    """The rows that an ordered fold keeps: one that fits in what is left is kept, another is skipped and later ones may still fit.

    ``order`` must be unique per row; rows of equal order may swap. Rows with a null or negative size are never kept.
    Each phase keeps the rows of at most half of what is left, up to the first larger one that fits or until half is used;
    so what is left halves with each phase, and there are at most log2(budget) + 1 of them, each a few aggregations.
    """
    columns = rows.columns
    rest, left, kept = _placed(rows.filter(F.col(size).between(0, budget)), order), budget, []
    while True:
        half = left // 2
        small = F.col(size) <= half
        rest = durable(_earlier(rest.filter(F.col(size) <= left).drop("value_", "offset_", "before_"), F.when(small, F.col(size)).otherwise(0)))
        ends = F.when(small, F.col("before_") > left - half).otherwise(F.col(size) <= left - F.col("before_"))
        end = rest.filter(ends).agg(F.min(F.struct("part_", "row_", F.col(size).alias("size_"), small.alias("small_"))).alias("end")).first().end
        if end is None:
            kept.append(rest.filter(small))
            break
        at, here = F.struct("part_", "row_"), F.struct(F.lit(end.part_), F.lit(end.row_))
        fits = rest.filter(small & (at < here))
        left -= fits.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        kept.append(fits)
        if end.small_:
            rest = rest.filter(at >= here)
        else:
            kept.append(rest.filter(at == here))
            left -= end.size_
            rest = rest.filter(at > here)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionAll(more)
    return out.select(*columns)


def handoff_plan(events: DataFrame, available: int, max_event: int, order: list[str], key: str = "id") -> DataFrame:
    """key, tokens, decision: too_large above ``max_event``, include while it fits in what is left, else over_budget.

    ``key`` is unique; null tokens are over budget.
    """
    fits = greedy_fill(events.filter(F.col("tokens") <= max_event), available, order, "tokens").select(key, F.lit(True).alias("fits"))
    decision = F.when(F.col("tokens") > max_event, "too_large").when(F.col("fits"), "include").otherwise("over_budget")
    return events.join(fits, key, "left").select(key, "tokens", decision.alias("decision"))
