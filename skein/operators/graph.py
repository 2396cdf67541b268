"""Reads and traversals of a property graph: nodes (id, kind, label, properties), edges (from_id, to_id, kind).

Traversals are bounded loops over a frontier; each round is one join of the frontier with the edges, and rounds are cut by
checkpoints, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.durable import durable

#: Rows of a frontier or an id set that are broadcast at most.
BROADCAST = 200_000
#: Ends of edges in one task of a join.
TASK = 500_000


def _sized(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows to join with, broadcast if they are few, and their number."""
    n = rows.count()
    return (F.broadcast(rows) if n <= BROADCAST else rows), n


def by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Point lookups of the distinct ids, in order of id."""
    return nodes.filter(F.col("id").isin(*sorted({*ids}))).orderBy("id")


def with_properties(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose properties have every wanted value; a missing key doesn't match."""
    for key, value in wanted.items():
        rows = rows.filter(F.col("properties")[key] == value)
    return rows


def page(rows: DataFrame, key: str = "id", cursor: str | None = None, limit: int = 100) -> DataFrame:
    """A keyset page: the next ``limit`` rows after the cursor in order of key, with next_cursor (the last key if more follow)."""
    if cursor is not None:
        rows = rows.filter(F.col(key) > cursor)
    ahead = rows.orderBy(key).limit(limit + 1)
    w = Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(key))
    out = ahead.withColumn("n_", n).withColumn("place_", place).filter(F.col("place_") <= limit)
    return out.withColumn("next_cursor", F.when(F.col("n_") > limit, F.max(key).over(w))).drop("n_", "place_")


def incident(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    """Edges from or to a node, each once."""
    own = edges if kind is None else edges.filter(F.col("kind") == kind)
    return own.filter(F.col("from_id") == node).union(own.filter(F.col("to_id") == node)).distinct()


def between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    a, b = ids.select(F.col("id").alias("from_id")).distinct(), ids.select(F.col("id").alias("to_id")).distinct()
    return edges.join(a, "from_id", "left_semi").join(b, "to_id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree; a self loop counts twice. One shuffle of partial sums."""
    ends = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("to_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))


def hubs(edges: DataFrame, top: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(top)


def ontology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from_kind, kind, to_kind, n of the relations that edges realise between node kinds."""
    a = nodes.select(F.col("id").alias("from_id"), F.col("kind").alias("from_kind"))
    b = nodes.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    return edges.join(a, "from_id").join(b, "to_id").groupBy("from_kind", "kind", "to_kind").agg(F.count(F.lit(1)).alias("n"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """id, hops of what is reached from the seeds (id) in at most ``depth`` steps; the seeds have 0.

    A small frontier is broadcast, and then the edges don't move; a large one is joined.
    """
    steps = edges.select("from_id", "to_id")
    if not directed:
        steps = steps.unionAll(steps.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    seen = durable(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    frontier, n = _sized(seen)
    known, held = _sized(seen)
    for hop in range(1, depth + 1):
        if not n:
            break
        reached = steps.join(frontier.select("id"), steps.from_id == F.col("id"), "left_semi").select(F.col("to_id").alias("id")).filter("id is not null").distinct()
        new = durable(reached.join(known.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        frontier, n = _sized(new)
        seen, held = seen.unionAll(new), held + n
        if hop % 16 == 0:
            seen = durable(seen)
        known = F.broadcast(seen) if held <= BROADCAST else seen
    return seen


def neighborhood(nodes: DataFrame, edges: DataFrame, center: str, depth: int, directed: bool = True) -> DataFrame:
    """The reached nodes with their hops; a center that isn't a node has none."""
    seeds = nodes.filter(F.col("id") == center).select("id")
    return walk(edges, seeds, depth, directed).join(nodes, "id").select("id", "kind", "label", "hops")


def ranked(found: DataFrame, edges: DataFrame, top: int, base: int = 120, per_hop: int = 18) -> DataFrame:
    """The best ``top`` nodes of a neighborhood: score falls with hops, few links add to it; ties go by id."""
    # fixed values: 120 less 18 a hop; 20 for a degree up to 3, 10 up to 10
    found = durable(found)
    ids, n = _sized(found.select("id"))
    ends = edges.select(F.col("from_id").alias("id")).unionAll(edges.select("to_id"))
    if n <= BROADCAST:
        ends = ends.join(ids, "id", "left_semi")
    else:  # a semi join would be done for each kind of edge by itself, in one task, and tasks are cut by compressed bytes
        parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ends.count() // TASK))
        ends = ends.repartition(parts, "id").join(ids.distinct().repartition(parts, "id"), "id")
    d = found.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    bonus = F.when(F.col("degree") <= 3, 20).when(F.col("degree") <= 10, 10).otherwise(0)
    return d.withColumn("score", F.greatest(F.lit(0), F.lit(base) - per_hop * F.col("hops")) + bonus).orderBy(F.desc("score"), "id").limit(top)


def shortest_paths(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """id, hops, path (array): one shortest path to each reached node, the least in order of its ids."""
    steps = durable(edges.select("from_id", "to_id").distinct())
    frontier = durable(steps.sparkSession.createDataFrame([(start, 0, [start])], "id string, hops int, path array<string>"))
    seen = frontier
    for hop in range(1, depth + 1):
        to = frontier.join(steps, frontier.id == steps.from_id).select(F.col("to_id").alias("id"), F.lit(hop).alias("hops"), F.concat("path", F.array("to_id")).alias("path"))
        frontier = durable(to.groupBy("id", "hops").agg(F.min("path").alias("path")).join(seen, "id", "left_anti").select("id", "hops", "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(a, b): b can be reached from a by one edge or more. Edges with a null end are left out. For graphs of bounded node count.

    Paths double each round: only the pairs that the last round found are joined with all pairs, and what that gives is
    compared with the known pairs of the same ends, so the pairs known before don't move for it.
    """
    reach = durable(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a is not null and b is not null").distinct())
    new = reach
    for _ in range(rounds):
        step = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        more = durable(new.join(step, "b").select("a", F.col("c").alias("b")).distinct())
        ends, n = _sized(more.select("b").distinct())
        if not n:
            break
        new = durable(more.join(reach.join(ends, "b", "left_semi"), ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        reach = reach.unionAll(new)
    return reach


def _trimmed(left: DataFrame) -> DataFrame:
    """The edges that can lie on cycles: those whose start is entered and whose end is left, again and again."""
    n = left.count()
    while n:
        core = left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi")
        core = durable(core.select("from_id", "to_id"))
        m = core.count()
        if m == n:
            break
        left, n = core, m
    return left


def _colored(left: DataFrame) -> DataFrame:
    """id, c: the least node that reaches a node, or itself. One aggregation by node a round, partial sums before the shuffle."""
    color = durable(left.select(F.col("from_id").alias("id")).union(left.select("to_id")).distinct().withColumn("c", F.col("id")))
    while True:
        come = left.join(color.select(F.col("id").alias("from_id"), "c"), "from_id").select(F.col("to_id").alias("id"), "c")
        new = come.unionAll(color.select("id", "c")).groupBy("id").agg(F.min("c").alias("c"))
        new = durable(new.join(color.select("id", F.col("c").alias("was")), "id"))
        color = new.select("id", "c")
        if new.filter("c <> was").isEmpty():
            return color


def component_members(edges: DataFrame) -> DataFrame:
    """id, component (least member), of all nodes: the strongly connected components.

    Nodes that lie on no cycle are trimmed. Then each node takes the least node that reaches it; what reaches that node
    back over nodes of its own is its component; the components found go, and the rest is taken again. Every step is a join
    of edges with nodes, so the work grows with edges times rounds, and no pairs of nodes are listed.
    """
    e = durable(edges.select("from_id", "to_id").filter("from_id is not null and to_id is not null").distinct())
    ids = durable(e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct())
    found, left = None, _trimmed(durable(e.filter("from_id <> to_id")))
    while not left.isEmpty():
        color = _colored(left)
        a, b = color.select(F.col("id").alias("from_id"), F.col("c").alias("ca")), color.select(F.col("id").alias("to_id"), F.col("c").alias("cb"))
        own = durable(left.join(a, "from_id").join(b, "to_id").filter("ca = cb").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
        back = walk(own, color.filter("id = c").select("id"), 1 << 20).select("id")
        part = durable(color.join(back, "id", "left_semi").select("id", F.col("c").alias("component")))
        found = part if found is None else found.unionAll(part)
        gone = part.select("id")
        rest = left.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        left = _trimmed(durable(rest.select("from_id", "to_id")))
    if found is None:
        return ids.withColumn("component", F.col("id"))
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """component (least member), size, is_cycle (size above 1, or a self loop), of call edges as from_id, to_id; by component_members."""
    loops = edges.filter("from_id = to_id").select(F.col("from_id").alias("id"), F.lit(True).alias("loop")).distinct()
    n = component_members(edges).join(loops, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max(F.coalesce("loop", F.lit(False))).alias("loop"))
    return n.select("component", "size", (F.col("loop") | (F.col("size") > 1)).alias("is_cycle"))


def dead_code(edges: DataFrame, entries: list[str]) -> DataFrame:
    """id, reason of nodes that no entry reaches, with self loops dropped."""
    e = edges.filter("from_id <> to_id").distinct()
    ids = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()
    seeds = e.sparkSession.createDataFrame([(x,) for x in entries], "id string")
    live = walk(e, seeds, 1 << 20).select("id")
    d = degrees(e)
    dead = ids.join(live, "id", "left_anti").join(d, "id", "left")
    reason = F.when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "isolated").when(F.col("in_degree") == 0, "unreachable").when(F.col("out_degree") == 0, "orphaned_leaf").otherwise("unreachable")
    return dead.select("id", reason.alias("reason"))


def health(edges: DataFrame) -> DataFrame:
    """id, overall: the mean of connectivity, reachability, centrality and freedom from cycles, to 6 places; self loops are dropped.

    What a node reaches is counted exactly, which lists all reachable pairs (``closure``): for graphs whose reachable
    pairs can be held.
    """
    given = edges.filter("from_id <> to_id").select("from_id", "to_id")
    ids = durable(given.select(F.col("from_id").alias("name")).union(given.select("to_id")).distinct().withColumn("id", F.xxhash64("name")))
    n, keys = ids.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if n == keys:  # pairs are of 64-bit keys, unless two ids have the same
        e = durable(given.select(F.xxhash64("from_id").alias("from_id"), F.xxhash64("to_id").alias("to_id")).distinct())
    else:
        e, ids = durable(given.distinct()), ids.select("name", F.col("name").alias("id"))
    reach, d = closure(e), durable(degrees(e))
    m = e.count()
    ahead = reach.groupBy(F.col("a").alias("id")).agg(F.sum((F.col("a") != F.col("b")).cast("int")).alias("f"), F.max((F.col("a") == F.col("b")).cast("int")).alias("risk"))
    back = reach.filter("a <> b").groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("g"))
    f, g, risk = (F.coalesce(c, F.lit(0)) for c in ("f", "g", "risk"))
    connectivity = F.least(F.lit(1.0), F.col("degree") / F.lit(float(min(2 * max(m / max(n, 1), 1), max(m, 1)))))
    reachability = (f + g) / F.lit(2.0 * max(n - 1, 1))
    centrality = (f + g + 2) / F.lit(2.0 * n) if n > 1 else F.lit(1.0)
    overall = (connectivity + reachability + centrality + 1 - risk) / 4
    return ids.join(d, "id").join(ahead, "id", "left").join(back, "id", "left").select(F.col("name").alias("id"), F.round(overall, 6).alias("overall"))


def dependency_batches(edges: DataFrame) -> DataFrame:
    """id, batch: what can run at once, from 0, when from_id goes before to_id; null on or behind a cycle. One round a batch."""
    left = durable(edges.select("from_id", "to_id").distinct())
    ids = durable(left.select(F.col("from_id").alias("id")).union(left.select("to_id")).distinct())
    out, batch = ids.limit(0).withColumn("batch", F.lit(0)), 0
    while True:
        ready = durable(ids.join(left.select(F.col("to_id").alias("id")), "id", "left_anti"))
        if ready.isEmpty():
            return out.unionAll(ids.withColumn("batch", F.lit(None).cast("int")))
        out = out.unionAll(ready.withColumn("batch", F.lit(batch)))
        left = durable(left.join(ready.select(F.col("id").alias("from_id")), "from_id", "left_anti").select("from_id", "to_id"))
        ids, batch = durable(ids.join(ready, "id", "left_anti")), batch + 1


def coupling(edges: DataFrame, module) -> DataFrame:
    """module, fan_in, fan_out, instability: distinct modules on the other end of edges between modules."""
    m = edges.select(module(F.col("from_id")).alias("a"), module(F.col("to_id")).alias("b")).filter("a <> b").distinct()
    both = m.select(F.col("a").alias("module"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(m.select("b", F.lit(0), F.lit(1)))
    out = both.groupBy("module").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return out.withColumn("instability", F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))


def delta(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change (insert, update, delete) between two projections; equal rows are left out. One shuffled join.

    Values are compared one by one, null equal to null alone. A null key meets none: it is an insert or a delete.
    """
    o = old.select(key, F.struct(*columns).alias("was"))
    n = new.select(key, F.struct(*columns).alias("is_now"))
    j = o.join(n, key, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"was.`{c}`").eqNullSafe(F.col(f"is_now.`{c}`"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("is_now").isNull(), "delete").when(~same, "update")
    return j.select(key, change.alias("change")).filter("change is not null")


def link_shared(nodes: DataFrame, prop: str) -> DataFrame:
    """Star edges (from_id, to_id) from each node to the least of those that share a property's value."""
    n = nodes.select("id", F.col("properties")[prop].alias("value")).filter("value is not null")
    least = n.groupBy("value").agg(F.min("id").alias("to_id"))
    return n.join(least, "value").filter("id <> to_id").select(F.col("id").alias("from_id"), "to_id")


def top_similar(vectors: DataFrame, query: list[float], top: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, score: the greatest dot products among vectors of the query's dimension; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector_col), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.filter(F.size(vector_col) == len(query)).select(id_col, F.round(dot, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(top)
