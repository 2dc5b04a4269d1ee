"""Streaming twins: verification state kept by micro-batches, and windowed activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators.state import upsert_newer


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are dropped by Spark's own rule."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class StateTable:
    """A keyed table kept as one Parquet version per micro-batch.

    A batch is merged into the newest version before it and written under its own number, so a batch that is run again
    after a failure overwrites only itself: results count once.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], date: str):
        self.spark, self.folder, self.keys, self.date = spark, folder.rstrip("/"), keys, date

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        done = [n for n in names if n.startswith("v=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.folder}/v={known[-1]}") if known else None

    def merge(self, batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in self.keys]), self.date).alias("row")).select(*self.keys, "row.*")
        old = self.read(before=number)
        merged = latest if old is None else upsert_newer(old, latest.select(*old.columns), self.keys, self.date)
        merged.write.mode("overwrite").parquet(f"{self.folder}/v={number}")


def keep_state(stream: DataFrame, state: StateTable, checkpoint: str):
    """Start a query that merges each micro-batch of the stream into the state table."""
    return stream.writeStream.foreachBatch(lambda batch, number: state.merge(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
