"""Streams of facts: windowed counts with a watermark, and running differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, at: str, key: list[str], size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts by key in tumbling or sliding windows; rows later than ``late`` are
    not waited for, so state stays bounded."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    counted = events.withWatermark(at, late).groupBy(w.alias("w"), *key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n")


def sessions(events: DataFrame, at: str, key: list[str], gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Counts by key in sessions that a gap ends."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n")


def first_seen(records: DataFrame, key: list[str], at: str, late: str = "2 days") -> DataFrame:
    """Each record once per watermark, however often it arrives."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def record_diffs(records: DataFrame, columns: list[str], path: str, checkpoint: str):
    """A stream of snapshots (``snapshot`` and ``columns``) as added and removed
    records of each against the latest one before.

    Every batch writes its snapshots and the differences as tables by batch number,
    so a batch that is run again after a failure overwrites what it wrote.
    """

    def step(batch: DataFrame, number: int) -> None:
        from evgraph.operators.findings import diff

        spark = batch.sparkSession
        head = batch.select(*columns).distinct()
        head.write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")
        head = spark.read.parquet(f"{path}/snapshots/batch={number}")
        base = spark.read.parquet(f"{path}/snapshots/batch={number - 1}") if number else head.limit(0)
        diff(base, head).write.mode("overwrite").parquet(f"{path}/diffs/batch={number}")

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
