"""A graph kept as versions of Parquet tables in one folder: writers add a version, readers take the newest whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graph import delta

KEYS = {"nodes": ["id"], "edges": ["from_id", "kind", "to_id"]}


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version whose tables are both whole; 0 for a new store."""
        if not self._files.exists(self._folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        numbers = sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)
        whole = (n for n in numbers if all(self._files.exists(self._at(f"v{n}/{t}/_SUCCESS")) for t in KEYS))
        return next(whole, 0)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}/{table}")

    def replace(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Writes a projection as the next version; of rows with one key the one of the greatest columns stays. Returns the version."""
        n = self.version() + 1
        for table, rows in (("nodes", nodes), ("edges", edges)):
            rest = [c for c in rows.columns if c not in KEYS[table]]
            one = rows.groupBy(*KEYS[table]).agg(F.max(F.struct(*rest)).alias("rest_")).select(*[c if c in KEYS[table] else F.col(f"rest_.`{c}`").alias(c) for c in rows.columns]) if rest else rows.distinct()
            one.write.mode("overwrite").parquet(f"{self.path}/v{n}/{table}")
        return n

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Inserts rows or replaces those of equal key. Returns the version."""
        if not self.version():
            return self.replace(nodes, edges)
        merged = [self.read(t).join(rows.select(*KEYS[t]), KEYS[t], "left_anti").unionByName(rows) for t, rows in (("nodes", nodes), ("edges", edges))]
        return self.replace(*merged)

    def delete_nodes(self, ids: DataFrame) -> int:
        """Deletes the nodes of ``ids`` (id) and all edges from or to them. Returns the version."""
        edges = self.read("edges")
        for end in ("from_id", "to_id"):
            edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
        return self.replace(self.read("nodes").join(ids, "id", "left_anti"), edges.select(*self.read("edges").columns))

    def drift(self, nodes: DataFrame) -> DataFrame:
        """id, change (insert, update, delete) that would make the stored nodes equal to ``nodes``; nothing is written."""
        return delta(self.read("nodes"), nodes, "id", ["kind", "label"])

    def compact(self) -> int:
        """Deletes all versions but the newest; returns how many."""
        newest, gone = self.version(), 0
        for s in self._files.listStatus(self._folder) if newest else []:
            if s.getPath().getName() != f"v{newest}":
                gone += bool(self._files.delete(s.getPath(), True))
        return gone
