"""Folds over streams of events, and refreshes of a stored projection from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_counts(events: DataFrame, width: str, late: str, time: str = "ts", key: str = "event_type") -> DataFrame:
    """begin, key, n, total of tumbling windows; events later than ``late`` behind the newest are dropped, null times too."""
    w = events.filter(F.col(time).isNotNull()).withWatermark(time, late).groupBy(F.window(time, width), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begin"), key, "n", "total")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key; of equal versions the greatest hash."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc(F.xxhash64(*rows.columns))))
    return rows.withColumn("place_", place).filter("place_ = 1").drop("place_")


def append_versions(stream: DataFrame, path: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """Appends each batch's newest row a key to a table in one folder a batch, so that a repeated batch replaces itself.

    Read it again with ``latest(spark.read.parquet(path), key, version)``.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
