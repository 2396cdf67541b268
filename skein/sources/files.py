"""Walks of file trees: paths, sizes and times only; contents are read by the readers that need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: languages by extension
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "js": "javascript", "go": "go", "java": "java", "md": "markdown", "json": "json", "xml": "xml"}


def walk(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """path, size, modified, extension, language (null: not supported) of files under a folder; hidden ones are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    found = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), extension.alias("extension"))
    return found.filter(~F.col("path").rlike(r"/\.[^/]+")).withColumn("language", known[F.col("extension")])


def skip_statistics(files: DataFrame) -> DataFrame:
    """extension, n of files without a language, most first."""
    return files.filter("language is null").groupBy("extension").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension")


def changed_since(files: DataFrame, since: str) -> DataFrame:
    return files.filter(F.col("modified") > F.lit(since).cast("timestamp"))


def edge_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON documents {nodes: [{id, kind, label}], edges: [{from_id, to_id, kind}]}; rows without a key are left out."""
    schema = "nodes array<struct<id: string, kind: string, label: string>>, edges array<struct<from_id: string, to_id: string, kind: string>>"
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = read.select(F.inline("nodes")).filter("id is not null").dropDuplicates(["id"])
    edges = read.select(F.inline("edges")).filter("from_id is not null and to_id is not null and kind is not null").distinct()
    return nodes, edges


def metric_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_no, metric, value of NDJSON lines {run, metrics: {name: number}}."""
    read = spark.read.schema("run long, metrics map<string, double>").json(path)
    return read.select(F.col("run").alias("run_no"), F.explode("metrics").alias("metric", "value")).filter("value is not null")
