"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.durable import durable, sweep


#: A node's edges are dealt over so many tasks; only as many rows a node meet in one task.
SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbor of its u, the edges of one u spread by a hash of v."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = part.withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node in ``edges``; a component is named by its least node.

    Large star, small star (Kiveris et al., 2014) until no edge changes: O(log^2 n) rounds, each linear in the edges.
    Self loops, repeated and reversed edges change nothing; edges with a null end are left out.
    """
    given = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null")
    e = durable(given.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        e = durable(small.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
        sweep(e.sparkSession)  # a round's shuffles and the edges before it are used up
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = given.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    return found.unionAll(alone).groupBy("node").agg(F.min("component").alias("component"))
