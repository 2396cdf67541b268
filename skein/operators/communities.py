"""Communities of a graph by modularity (Blondel et al., 2008), all nodes of a sweep at once; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.durable import durable


def _weights(edges: DataFrame) -> DataFrame:
    """(u, v, w) both ways, one row a pair: undirected edges without repeats and self loops, weight 1."""
    e = edges.select(F.greatest("from_id", "to_id").alias("u"), F.least("from_id", "to_id").alias("v")).filter("u <> v").distinct()
    return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("w", F.lit(1.0))


def modularity(w: DataFrame, member: DataFrame) -> float:
    """Of (u, v, w) rows both ways (self loops once, with their weight doubled) and members (node, c); 0 without edges."""
    a, b = member.select(F.col("node").alias("u"), F.col("c").alias("cu")), member.select(F.col("node").alias("v"), F.col("c").alias("cv"))
    tot = w.join(a, "u").join(b, "v").groupBy("cu").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("own"))
    row = tot.agg(F.sum("tot").alias("all"), F.sum("own").alias("own"), F.sum(F.col("tot") * F.col("tot")).alias("square")).first()
    return row.own / row.all - row.square / row.all**2 if row.all else 0.0


def _sweep(w: DataFrame, member: DataFrame, total: float, turn: int) -> DataFrame:
    """Each node whose turn it is goes to the neighboring community of the greatest positive gain, the least of equals."""
    degree = w.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    known = member.join(degree, "node")
    tot = known.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("tot"))
    to = w.filter("u <> v").join(member.select(F.col("node").alias("v"), F.col("c").alias("to")), "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("inside"))
    gain = F.col("inside") - F.col("k") * (F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / F.lit(total)
    options = to.join(tot, "to").join(known, "node").select("node", "c", "to", gain.alias("gain"))
    # without edges inside its community a node keeps the loss that it has there as its measure
    alone = known.join(tot.withColumnRenamed("to", "c"), "c").select("node", "c", F.col("c").alias("to"), (-F.col("k") * (F.col("tot") - F.col("k")) / F.lit(total)).alias("gain"))
    every = options.unionAll(alone).groupBy("node", "c", "to").agg(F.max("gain").alias("gain"))
    best = every.groupBy("node", "c").agg(F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay"), F.min(F.struct((-F.col("gain")).alias("neg"), "to")).alias("best"))
    moves = (-F.col("best.neg") > F.col("stay") + 1e-9) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
    return best.select("node", F.when(moves, F.col("best.to")).otherwise(F.col("c")).alias("c"))


def communities(edges: DataFrame, sweeps: int = 20, levels: int = 10, patience: int = 3) -> DataFrame:
    """(node, community): the community is named by a member. Nodes without edges to others are left out.

    In a sweep a random half of the nodes moves at once, so the modularity may fall; the best members of a level's sweeps
    stand, and a level ends after ``patience`` sweeps without a better one. Then communities become nodes, until no level
    helps. Every sweep is a few aggregations by node and community, cut by a checkpoint.
    """
    w = durable(_weights(edges))
    names = durable(w.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")))
    total = w.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    turn = 0
    for _ in range(levels if total else 0):
        member = durable(names.select(F.col("community").alias("node")).distinct().withColumn("c", F.col("node")))
        first = best = modularity(w, member)
        kept, waited = member, 0
        for _ in range(sweeps):
            turn += 1
            member = durable(_sweep(w, member, total, turn))
            now = modularity(w, member)
            if now > best + 1e-9:
                best, kept, waited = now, member, 0
            else:
                waited += 1
                if waited >= patience:
                    break
        if best <= first + 1e-9:
            break
        merged = kept.select(F.col("node").alias("community"), "c")
        names = durable(names.join(merged, "community").select("node", F.col("c").alias("community")))
        a, b = kept.select(F.col("node").alias("u"), F.col("c").alias("cu")), kept.select(F.col("node").alias("v"), F.col("c").alias("cv"))
        w = durable(w.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    return names
