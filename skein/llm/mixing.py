"""Mixing sources to target weights by a curriculum that varies over training time.

Each source has a share of the budget and a ramp, its weight as a line over training time from 0 to 1. The
integral of the ramp, scaled to the source's target, is the source's cumulative demand for words. Documents of
a source stand in the order of a hash of their ids; the inverse of the demand at a document's first word is its
training position, in its first serving and, further along the demand, in its second. The mix is range-sorted by position.

A source's running sums are taken in two steps, so that no task holds a source: sums of narrow hash buckets,
running sums over buckets, then running sums within each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.durable import durable
from skein.llm.text import WORD

#: Rows that a hash bucket holds on average, over all sources.
BUCKET = 2048
#: Weights at the start and the end of training, dealt to the sources in their order.
RAMPS = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def _dealt(values: tuple, rank) -> F.Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) with each source's weight rank and target.

    Weights are dealt to sources by code point, null last. Water is poured: a source is full at ``cap`` times its
    size, and what it can't take rises in the others by weight. In order of cap per weight the full ones come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", _dealt(weights, F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("goal", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(every))
    t = t.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("first", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("place"))).over(every))
    t = t.withColumn("water", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(every))
    full = F.col("first").isNull() | (F.col("place") < F.col("first"))
    return t.select("source", "source_size", "rank", F.when(full, F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def _position(done, rank, ramps) -> F.Column:
    """Training time at which a source has demanded the part ``done`` of its target."""
    a, b = _dealt([2 * x / (x + y) for x, y in ramps], rank), _dealt([2 * y / (x + y) for x, y in ramps], rank)
    return F.when(a == b, done).otherwise((F.sqrt(a * a + 2 * (b - a) * done) - a) / (b - a))


def _planned(docs: DataFrame, weights: tuple, share: float, cap: float, ramps: tuple, keep: tuple, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every row with what its two servings take (once, twice) and where they stand (at_once, at_twice; null if nothing)."""
    if cap > 2:
        raise ValueError("a document is taken twice at most")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("hash"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    rows = durable(rows)
    n_buckets = max(1, rows.count() // BUCKET)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * n_buckets).cast("long"))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    aims = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    b, s = buckets.alias("b"), aims.alias("s")
    plan = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("b.source").alias("of"), F.col("b.bucket").alias("at"), "ahead", "source_size", "rank", "target")
    within = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    r = rows.join(plan, rows.source.eqNullSafe(plan.of) & (rows.bucket == plan["at"]))
    r = r.withColumn("start", F.col("ahead") + F.col("inner")).withColumn("whole", F.floor("target"))
    for name, x in (("once", F.col("start")), ("twice", F.col("start") + F.col("source_size"))):
        r = r.withColumn(name, F.greatest(F.lit(0), F.least(F.col("size"), F.col("whole") - x)).cast("long"))
        r = r.withColumn(f"at_{name}", F.when(F.col(name) > 0, _position(x / F.col("target"), F.col("rank"), ramps)))
    return r


def curriculum_mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, ramps: tuple = RAMPS, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, position, position_2 of every row, in order of position.

    The first ``floor(target)`` words of a source's documents, in hash order and then once more from the start, are
    taken; so the last document may be taken in part, and no word more than ``cap`` times (2 at most are served).
    position: training time in 0..1 of the first taken word; null (and last) for documents of which nothing is taken.
    position_2: that of the second serving's first word; null for documents that are not served twice.
    Null texts have size 0; null sources are one source, the last; a null id hashes as the empty text. Repeated rows
    count each; equal hashes go by id, then size. An empty table gives no rows. Columns in ``keep`` come along.
    Both servings are counted in taken; ``curriculum_servings`` has a row for each.
    """
    r = _planned(docs, weights, share, cap, ramps, keep, id_col, text_col, source_col)
    r = r.withColumn("taken", F.col("once") + F.col("twice")).withColumn("position", F.col("at_once")).withColumn("position_2", F.col("at_twice"))
    return r.orderBy(F.col("position").asc_nulls_last(), "hash").select("doc_id", "size", "source_size", "target", "taken", "position", "position_2", *[F.col(f"kept_{c}").alias(c) for c in keep])


def curriculum_servings(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, ramps: tuple = RAMPS, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, serving, taken, position: ``curriculum_mix`` with a row a serving, in order of position.

    Every row has its first serving (of 0 words, without a position, if nothing is taken), and its second where that takes words.
    """
    r = _planned(docs, weights, share, cap, ramps, keep, id_col, text_col, source_col)
    one = lambda k, name: F.struct(F.lit(k).alias("serving"), F.col(name).alias("taken"), F.col(f"at_{name}").alias("position"))
    r = r.withColumn("served", F.explode(F.when(F.col("twice") > 0, F.array(one(1, "once"), one(2, "twice"))).otherwise(F.array(one(1, "once")))))
    kept = [F.col(f"kept_{c}").alias(c) for c in keep]
    return r.select("doc_id", "size", "source_size", "target", "served.*", "hash", *kept).orderBy(F.col("position").asc_nulls_last(), "hash", "serving").drop("hash")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
g AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS goal, sum(weight) OVER () AS all_weight, row_number() OVER (ORDER BY cap / weight, rank) AS place FROM w),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level FROM g WINDOW b AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN cap / weight >= level THEN place END) OVER () AS first FROM l),
t AS (SELECT source, source_size, rank, CASE WHEN first IS NULL OR place < first THEN cap ELSE max(CASE WHEN place = first THEN level END) OVER () * weight END AS target FROM f),
c AS (SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
k AS (SELECT doc_id, size, source_size, target, rank, start, CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken, least(size, floor(target) - start - source_size) AS twice FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE rank % 3 WHEN 0 THEN (sqrt(2.25::DOUBLE - 2.0::DOUBLE * (start / target)) - 1.5::DOUBLE) / (-1.0::DOUBLE) WHEN 1 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * (start / target)) - 0.5::DOUBLE) / 1.0::DOUBLE ELSE start / target END END AS position,
  CASE WHEN twice > 0 THEN CASE rank % 3 WHEN 0 THEN (sqrt(2.25::DOUBLE - 2.0::DOUBLE * ((start + source_size) / target)) - 1.5::DOUBLE) / (-1.0::DOUBLE) WHEN 1 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * ((start + source_size) / target)) - 0.5::DOUBLE) / 1.0::DOUBLE ELSE (start + source_size) / target END END AS position_2
FROM k
"""
