"""Scores of nodes and edges, neighborhoods of several seeds, and budgets of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.durable import durable


def _by_kind(kind: Column, table: list[tuple[int, list[str]]], otherwise: Column) -> Column:
    out = None
    for score, kinds in table:
        out = (F if out is None else out).when(kind.isin(kinds), score)
    return out.otherwise(otherwise)


def edge_kind_score(kind: Column) -> Column:
    """How much an edge's kind counts; whole names before parts of names; a null kind counts as another kind."""
    # fixed values
    table = [
        (34, ["semantic_relation"]),
        (28, ["mentions_entity", "mentions_concept", "tagged_entity", "tagged_concept", "related_concept"]),
        (22, ["mentions"]),
        (20, ["calls"]),
        (18, ["requests_context", "scopes_context", "scopes_source", "explains_result"]),
        (12, ["defines", "contains", "belongs_to"]),
    ]
    part = F.when(kind.contains("community"), 20).when(kind.rlike("semantic|concept|entity"), 24).otherwise(8)
    return _by_kind(kind, table, part)


def _seed_bonus(kind: Column) -> Column:
    # fixed values
    table = [
        (30, ["mentions_concept", "mentions_entity", "tagged_concept", "tagged_entity", "related_concept"]),
        (28, ["semantic_relation"]),
        (24, ["calls"]),
        (22, ["mentions"]),
        (18, ["requests_context", "scopes_context", "scopes_source", "explains_result"]),
        (12, ["defines", "contains", "belongs_to"]),
    ]
    return _by_kind(kind, table, F.lit(0))


def recency_bonus(observed: Column, now: int, half_life: int = 7 * 86_400, weight: int = 24) -> Column:
    """The weight in the first half life, half of it in the second, a quarter in the next two; 0 later or if null. The future is now."""
    age = F.floor(F.greatest(F.lit(now) - observed, F.lit(0)) / F.lit(max(half_life, 1)))
    return F.when(observed.isNull(), 0).when(age == 0, weight).when(age == 1, weight // 2).when(age <= 3, weight // 4).otherwise(0)


def memory_bonus(kind: Column, provided: Column, confidence: Column, bonus: int = 18) -> Column:
    """A bonus for nodes of the memory: its whole for findings, decisions and events, half for notes and sessions.

    ``provided`` marks nodes that the memory itself wrote; others count by their kind alone. Confidence adds up to a bonus more.
    """
    own = F.coalesce(provided, F.lit(False))
    is_memory = (kind.startswith("memory_") | own | kind.isin("finding", "decision", "note")) & (kind != "memory_projection")
    base = F.when(kind.isin("finding", "decision", "memory_event"), bonus).when(kind.isin("note", "memory_session") | own, bonus // 2).otherwise(bonus)
    sure = F.round(bonus * F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).cast("int")
    return F.when(is_memory, base + sure).otherwise(0)


def seeded_neighborhood(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int, limit: int = 0, per_node: int = 0, cap: int = 0) -> DataFrame:
    """id, kind, label, seed_rank, hops, score of what edges of either direction reach from the seeds in ``depth`` steps.

    Seeds come first, in order, then others by score and id; ``limit`` rows are kept (0: all). A node's score is the best of
    the edges that lead to it from an expanded node. ``per_node`` keeps a node's best edges, ``cap`` the best nodes of a step
    (0: all). Seeds that aren't nodes are left out; repeated seeds count once. One round a step, cut by checkpoints.
    """
    spark = nodes.sparkSession
    order = list(dict.fromkeys(seeds))
    start = spark.createDataFrame([(s, k) for k, s in enumerate(order)], "id string, seed_rank int")
    found = durable(start.join(nodes.select("id").distinct(), "id", "left_semi").withColumn("hops", F.lit(0)))
    frontier, seen, scores = found.select("id"), found.select("id", "hops"), found.select("id", (F.lit(1_000_000) - F.col("seed_rank")).alias("score"))
    for hop in range(depth):
        out = frontier.join(edges, frontier.id == edges.from_id).select("id", F.col("to_id").alias("other"), "kind", F.lit(8).alias("way"))
        back = frontier.join(edges, frontier.id == edges.to_id).filter("from_id <> to_id").select("id", F.col("from_id").alias("other"), "kind", F.lit(4).alias("way"))
        step = out.unionAll(back).withColumn("score", 10 * edge_kind_score(F.col("kind")) + F.col("way") + _seed_bonus(F.col("kind")) + 5 * (depth - hop))
        if per_node:
            best = Window.partitionBy("id").orderBy(F.desc("score"), "other")  # limited before the shuffle as well
            step = step.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= per_node)
        reached = durable(step.groupBy(F.col("other").alias("id")).agg(F.max("score").alias("score")).join(nodes.select("id").distinct(), "id", "left_semi"))
        fresh = reached.join(seen, "id", "left_anti")
        if cap:
            fresh = fresh.orderBy(F.desc("score"), "id").limit(cap)
        fresh = durable(fresh.select("id", F.lit(hop + 1).alias("hops")))
        known = seen.unionAll(fresh)
        scores = scores.unionAll(reached.join(known, "id", "left_semi"))
        frontier, seen = fresh.select("id"), known
        if fresh.isEmpty():
            break
    best = scores.groupBy("id").agg(F.max("score").cast("long").alias("score"))
    rows = seen.join(best, "id").join(found.select("id", "seed_rank"), "id", "left").join(nodes.select("id", "kind", "label"), "id")
    rows = rows.select("id", "kind", "label", "seed_rank", "hops", "score").orderBy(F.asc_nulls_last("seed_rank"), F.desc("score"), "id")
    return rows.limit(limit) if limit else rows


def output_budget(rows: DataFrame, order: list, quota: int, cap: int, kind: str = "kind", tokens: str = "tokens") -> DataFrame:
    """The rows within ``quota`` a kind in the order, then up to the first that would pass ``cap`` tokens in all.

    The quota cuts each kind before the shuffle; what is left, a quota of each kind, is summed in one task.
    """
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    within = rows.withColumn("place_", place).filter(F.col("place_") <= quota).drop("place_")
    used = F.sum(F.coalesce(tokens, F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return within.withColumn("used_", used).filter(F.col("used_") <= cap).drop("used_")


def confident_entities(candidates: DataFrame, seeds: list[str], least: float = 0.0, top: int = 32) -> DataFrame:
    """node_id, label, degree, confidence, matched: the entities to show for seed phrases.

    Those that share a word with a seed come first, then by degree, a model's confidence before a default, confidence and id.
    Above 0, ``least`` also leaves out confidences that are only defaults (``derived``).
    """
    words = sorted({w.lower() for s in seeds for w in s.replace("_", " ").replace("-", " ").split()})
    label = F.split(F.lower(F.coalesce("label", F.lit(""))), r"[^\p{L}\p{N}]+")
    matched = F.arrays_overlap(label, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    rows = candidates.withColumn("matched", matched)
    if least > 0:
        rows = rows.filter(~F.col("derived") & (F.col("confidence") >= least))
    ranked = rows.orderBy(F.desc("matched"), F.desc("degree"), "derived", F.desc("confidence"), "node_id")
    return ranked.limit(top).select("node_id", "label", "degree", "confidence", "matched")
