"""The engine's relations as they are bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, label, properties."""
    props = lambda **k: F.create_map(*[x for name, c in k.items() for x in (F.lit(name), F.col(c).cast("string"))])
    region = table(spark, d, "region").select(_key("region", "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("label"), props(name="r_name").alias("properties"))
    nation = table(spark, d, "nation").select(_key("nation", "n_nationkey"), F.lit("nation"), "n_name", props(name="n_name", region="n_regionkey"))
    customer = table(spark, d, "customer").select(_key("customer", "c_custkey"), F.lit("customer"), "c_name", props(segment="c_mktsegment", nation="c_nationkey"))
    supplier = table(spark, d, "supplier").select(_key("supplier", "s_suppkey"), F.lit("supplier"), "s_name", props(nation="s_nationkey"))
    order = table(spark, d, "orders").select(_key("order", "o_orderkey"), F.lit("order"), "o_orderpriority", props(status="o_orderstatus", priority="o_orderpriority"))
    return region.unionAll(nation).unionAll(customer).unionAll(supplier).unionAll(order)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """from_id, to_id, kind."""
    def link(name, a, ka, b, kb, kind):
        return table(spark, d, name).select(_key(a, ka).alias("from_id"), _key(b, kb).alias("to_id"), F.lit(kind).alias("kind"))

    return (
        link("nation", "nation", "n_nationkey", "region", "n_regionkey", "in_region")
        .unionAll(link("customer", "customer", "c_custkey", "nation", "c_nationkey", "in_nation"))
        .unionAll(link("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"))
        .unionAll(link("orders", "customer", "o_custkey", "order", "o_orderkey", "placed"))
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee: each user's transitions from one event (type and hour) to the next, a cyclic graph of bounded size."""
    from pyspark.sql import Window

    name = F.concat(F.col("event_type"), F.lit("."), F.hour("ts").cast("string"))
    e = table(spark, d, "events").select("user_id", "ts", "event_id", name.alias("caller"))
    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("callee", F.lead("caller").over(after)).filter("callee is not null").select("caller", "callee")


def dag(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee: suppliers to parts to brands, without cycles."""
    li = table(spark, d, "lineitem").select(_key("supplier", "l_suppkey").alias("caller"), _key("part", "l_partkey").alias("callee")).distinct()
    p = table(spark, d, "part").select(_key("part", "p_partkey"), _key("brand", "p_brand"))
    return li.unionAll(p)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def memory(spark: SparkSession, d: str) -> DataFrame:
    """id, session_id, text, observed_at."""
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("session_id"), "text", (F.col("conv_id") * 60 + F.col("turn")).alias("observed_at"))


#: The same relations for DuckDB.
SQL = """
WITH nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label, NULL AS segment, NULL AS status FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority, NULL, o_orderstatus FROM orders),
edges AS (
  SELECT 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 'in_region' AS kind FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'placed' FROM orders),
ev AS (SELECT user_id, ts, event_id, event_type || '.' || hour(ts) AS caller FROM events),
calls AS (SELECT caller, callee FROM (SELECT caller, lead(caller) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM ev) WHERE callee IS NOT NULL),
dag AS (
  SELECT DISTINCT 'supplier:' || l_suppkey AS caller, 'part:' || l_partkey AS callee FROM lineitem
  UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand FROM part),
lines AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
memory AS (SELECT conv_id || ':' || turn AS id, conv_id AS session_id, text, conv_id * 60 + turn AS observed_at FROM conversations)
"""
#: The same head for queries that recurse.
SQL_RECURSIVE = SQL.replace("WITH nodes", "WITH RECURSIVE nodes", 1)
