"""Search over symbols (name, kind, file, line), ranks of hits, what changes touch, and conflicts between planned changes."""

from __future__ import annotations

import re
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.durable import durable

#: Targets whose codes are broadcast at most; more are joined.
CODED = 1_000_000
#: Ordered pairs of one task.
PAIRS = 4_000_000


def tags(name: Column) -> Column:
    """The distinct lower-cased words of a name, split at other characters and where a capital follows a small letter or digit."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def query_tags(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", query).lower())))


def symbol_search(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """name, file, line, exact, score: exact names (in either case) score 1, others the F0.5 of shared words.

    A partial match shares at least half of the query's words, rounded up. The first ``limit`` by exactness, shared words,
    fewest words of the name, name, file and line are kept, then ordered by score. Null names match nothing.
    """
    wanted = query_tags(query)
    t = symbols.filter("name is not null").withColumn("tags_", tags(F.col("name")))
    shared = F.size(F.array_intersect("tags_", F.array(*[F.lit(w) for w in wanted]))) if wanted else F.lit(0)
    t = t.withColumn("shared_", shared).withColumn("exact", F.lower("name") == query.lower())
    t = t.filter(F.col("exact") | (F.col("shared_") >= max((len(wanted) + 1) // 2, 1)))
    precision, recall = F.col("shared_") / F.lit(float(max(len(wanted), 1))), F.col("shared_") / F.greatest(F.size("tags_"), F.lit(1))
    score = F.when(F.col("exact"), 1.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    first = t.orderBy(F.desc("exact"), F.desc("shared_"), F.size("tags_"), F.lower("name"), "file", "line").limit(limit)
    return first.select("name", "file", "line", "exact", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.lower("name"), "file", "line")


def overlap_rank(entries: DataFrame, query: str, top: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, shared: the entries that share most distinct words with the query; ties by id."""
    words = F.array(*[F.lit(w) for w in query_tags(query)]).cast("array<string>")
    shared = F.size(F.array_intersect(tags(F.col(text_col)), words))
    return entries.select(F.col(id_col).alias("id"), shared.alias("shared")).filter("shared > 0").orderBy(F.desc("shared"), "id").limit(top)


def looks_like_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|[/_.-])(tests?|specs?)([/_.-]|$)")


def symbol_rank(hits: DataFrame) -> DataFrame:
    """``hits`` with rank: of (score, exact, has_span, summaries, neighbors, is_definition, file) rows; null marks count as no."""
    no = lambda c, v=False: F.coalesce(F.col(c), F.lit(v))
    # fixed values
    rank = 40 + 50 * F.least(F.greatest(no("score", 0.0), F.lit(0.0)), F.lit(1.0))
    rank = rank + F.when(no("exact"), 10).otherwise(0) + F.when(no("has_span"), 20).otherwise(0)
    rank = rank + F.least(F.lit(10), 5 * no("summaries", 0)) + F.least(F.lit(12), 4 * no("neighbors", 0))
    rank = rank + F.when(no("is_definition"), 8).otherwise(0) + F.when(looks_like_test(F.col("file")), -18).otherwise(6)
    return hits.withColumn("rank", rank)


def lexical_rank(hits: DataFrame) -> DataFrame:
    """``hits`` with rank: of (score, confidence, has_handle, has_symbol, file) rows; null marks count as no."""
    # fixed values
    rank = F.least(F.lit(45.0), 0.45 * F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)))
    rank = rank + F.when(F.lower("confidence") == "high", 3).otherwise(0) + F.when(F.col("has_handle"), 5).otherwise(0)
    rank = rank + F.when(F.col("has_symbol"), 4).otherwise(0) - F.when(looks_like_test(F.col("file")), 12).otherwise(0)
    return hits.withColumn("rank", rank)


def merged_ranking(symbols: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    """file, line, name, rank of ranked symbols and texts together; ties by file, line and name."""
    both = symbol_rank(symbols).select("file", "line", "name", "rank").unionByName(lexical_rank(texts).select("file", "line", F.lit(None).cast("string").alias("name"), "rank"))
    return both.orderBy(F.desc("rank"), "file", "line", "name").limit(top)


def impact(tests: DataFrame, changed: DataFrame, symbols: DataFrame, calls: DataFrame, routes: DataFrame, imports: DataFrame, limit: int = 0) -> DataFrame:
    """path, reasons, n_symbols of the test files that a change touches, those with most reasons first.

    ``tests`` (path); ``changed`` (path); ``symbols`` (name) of changed files; ``calls`` (path, callee) from test files;
    ``routes`` (path, handler) that test files use; ``imports`` (path, token). Names meet in either case. A file's distinct
    reasons are changed, calls, route and imports; its symbols are the distinct changed names that it meets.
    """
    names = symbols.select(F.lower("name").alias("low")).filter("low is not null").distinct()

    def meet(rows: DataFrame, column: str, reason: str) -> DataFrame:
        r = rows.select("path", F.lower(column).alias("low")).distinct().join(names, "low", "left_semi")
        return r.select("path", F.lit(reason).alias("reason"), "low")

    direct = changed.select("path").distinct().select("path", F.lit("changed").alias("reason"), F.lit(None).cast("string").alias("low"))
    hits = direct.unionAll(meet(calls, "callee", "calls")).unionAll(meet(routes, "handler", "route")).unionAll(meet(imports, "token", "imports"))
    found = hits.join(tests.select("path").distinct(), "path", "left_semi").groupBy("path")
    out = found.agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.countDistinct("low").alias("n_symbols")).orderBy(F.desc(F.size("reasons")), "path")
    return out.limit(limit) if limit else out


def _coded(targets: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(target, code) of distinct targets with codes from 0 in the given order, to be broadcast if they are few, and their number."""
    t = durable(targets.orderBy(*order).select("target", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)  # the rows of a partition are numbered from its own number times 2 ** 33
    sizes = sorted(tuple(r) for r in t.groupBy(part.cast("int")).count().collect())
    begins = list(accumulate((n for _, n in sizes), initial=0))
    n = begins.pop()
    kind = "int" if n < 1 << 31 else "bigint"
    rows = [(p, b) for (p, _), b in zip(sizes, begins, strict=True)]
    begin = targets.sparkSession.createDataFrame(rows, "part int, begin long")
    code = (F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast(kind)
    codes = durable(t.withColumn("part", part.cast("int")).join(F.broadcast(begin), "part").select("target", code.alias("code")))
    return (F.broadcast(codes) if n <= CODED else codes), n


def _claimants(claims: DataFrame, codes: DataFrame) -> DataFrame:
    """surface, held of the members that two targets or more claim: the claimants' codes in order."""
    c = claims.filter("member is not null and surface is not null").join(codes, "target")
    held = c.select("surface", "member", "code").groupBy("surface", "member").agg(F.array_sort(F.collect_set("code")).alias("held"))
    return durable(held.filter(F.size("held") > 1).select("surface", "held"))


def _tasks(lists: DataFrame) -> int:
    """So many tasks that one has about PAIRS of the ordered pairs that the lists make."""
    n = F.size("held").cast("double")
    made = lists.agg(F.sum(n * (n - 1))).first()[0] or 0
    return max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(made / PAIRS))


def conflicts(claims: DataFrame) -> DataFrame:
    """a, b, files, config, symbols, tests, score, risk of the pairs of targets that claim a member of the same surface.

    ``claims`` (target, surface, member), surface one of file, config, symbol and test. Pairs without a shared member have
    risk low and score 0 and aren't listed: targets meet by member, never all with all. Each claimant is sent the codes of
    those after it as one array, and pairs are made and counted where they arrive, so pairs themselves aren't shuffled.
    """
    c = claims.select("target", "surface", "member")
    codes, _ = _coded(c.filter("target is not null").select("target").distinct(), ["target"])
    lists = _claimants(c, codes)
    surface = F.when(F.col("surface") == "file", 0).when(F.col("surface") == "config", 1).when(F.col("surface") == "symbol", 2).when(F.col("surface") == "test", 3).otherwise(4)
    sent = lists.select(surface.cast("byte").alias("s"), "held", F.posexplode("held").alias("i", "x")).filter(F.col("i") < F.size("held") - 1)
    sent = sent.select("x", "s", F.slice("held", F.col("i") + 2, F.size("held")).alias("rest")).repartition(_tasks(lists), "x")
    n = lambda s: F.sum((F.col("s") == s).cast("long"))
    p = sent.select("x", "s", F.explode("rest").alias("y")).groupBy("x", "y").agg(n(0).alias("files"), n(1).alias("config"), n(2).alias("symbols"), n(3).alias("tests"))
    for k, end in (("x", "a"), ("y", "b")):
        p = p.join(codes.select(F.col("code").alias(k), F.col("target").alias(end)), k)
    # fixed values: 100 a file, 100 a config file, 40 a symbol, 10 a test
    score = 100 * F.col("files") + 100 * F.col("config") + 40 * F.col("symbols") + 10 * F.col("tests")
    risk = F.when((F.col("files") > 0) | (F.col("config") > 0), "fail_closed").when(F.col("symbols") > 0, "high").when(F.col("tests") > 0, "medium").otherwise("low")
    return p.select("a", "b", "files", "config", "symbols", "tests", score.alias("score"), risk.alias("risk"))


def schedule(targets: DataFrame, claims: DataFrame) -> DataFrame:
    """target, blocks, blocked_by (sorted ids), parallel_safe of distinct ``targets`` (target, rank) under the conflicts of
    ``claims`` (target, surface, member) of high risk or more.

    Of a pair the target of the lower rank blocks, of equal ranks the one listed first: codes follow rank and target, so the
    lower code blocks. Each claimant of a file, config file or symbol is sent the codes of all of them, and pairs are made,
    told apart and listed where they arrive, so pairs themselves aren't shuffled.
    """
    codes, _ = _coded(targets, ["rank", "target"])
    lists = _claimants(claims.filter(F.col("surface").isin("file", "config", "symbol")), codes)
    alone = codes.select(F.col("code").alias("x"), F.array("code").alias("held"))  # so that each target has a row
    sent = lists.select(F.explode("held").alias("x"), "held").unionAll(alone).repartition(_tasks(lists), "x")
    p = sent.select("x", F.explode("held").alias("y")).distinct()
    p = p.join(codes.select(F.col("code").alias("y"), F.col("target").alias("other")), "y")
    ends = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("other"))))
    p = p.groupBy("x").agg(ends(F.col("y") > F.col("x")).alias("blocks"), ends(F.col("y") < F.col("x")).alias("blocked_by"))
    out = p.join(codes.select(F.col("code").alias("x"), "target"), "x").select("target", "blocks", "blocked_by")
    return out.withColumn("parallel_safe", (F.size("blocks") == 0) & (F.size("blocked_by") == 0))


def on_cycles(edges: DataFrame) -> DataFrame:
    """id: the nodes that lie on a cycle of (from_id, to_id) or between cycles; none if the edges have no cycle.

    Nodes without an edge in or without an edge out go, until none does; a round takes one aggregation of what is left.
    """
    left = durable(edges.select("from_id", "to_id").distinct())
    n = left.count()
    while n:
        left = durable(left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").select("from_id", "to_id"))
        left = durable(left.join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").select("from_id", "to_id"))
        n, before = left.count(), n
        if n == before:
            break
    return left.select(F.col("from_id").alias("id")).distinct()
