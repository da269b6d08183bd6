"""Incremental synchronisation as Structured Streaming: replay-safe batches into versioned snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_changes(spark: SparkSession, path: str, schema: StructType, stamp: str, files_per_batch: int = 64) -> DataFrame:
    """ST01: new files of a change feed, its stamp as an event time in UTC."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn(stamp, F.col(stamp).cast("timestamp"))


def replay_safe(changes: DataFrame, key: str, stamp: str, replay: str = "300 seconds") -> DataFrame:
    """ST01: drops what a replay within ``replay`` delivers again."""
    return changes.withWatermark(stamp, replay).dropDuplicatesWithinWatermark([key])


def newest(rows: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """ST02: one row per key, the newest; a record older than the stored one changes nothing."""
    others = [c for c in rows.columns if c not in (key, stamp, tie)]
    best = rows.groupBy(key).agg(F.max(F.struct(stamp, tie, *others)).alias("r"))
    return best.select(key, "r.*").select(*rows.columns)


#: Buckets of keys that a snapshot is kept in.
BUCKETS = 64


def snapshot(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The rows as of the last version (or the last below ``before``): of each bucket of keys, its newest version."""
    rows = spark.read.parquet(folder)
    rows = rows if before is None else rows.filter(F.col("version") < before)
    newest_of = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest_of), ["bucket", "version"]).drop("version")  # at most BUCKETS rows


def upsert_into(folder: str, key: str, stamp: str, tie: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """ST03: a batch writer with exactly-once effect.

    Batch n makes version n of the buckets that it touches, from their last version below n; other
    buckets stay as they are. A batch that is run again after a failure overwrites its own version only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if rows.isEmpty():
            return
        if number:
            touched = rows.select("bucket").distinct()
            rows = snapshot(spark, folder, number).join(F.broadcast(touched), "bucket", "left_semi").unionByName(rows)  # at most BUCKETS rows
        newest(rows, key, stamp, tie).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={number}")

    return write


def sync(changes: DataFrame, folder: str, checkpoint: str, key: str, stamp: str, tie: str) -> DataFrame:
    """Runs all that is there now through the upsert, and gives the snapshot after it."""
    run = changes.writeStream.foreachBatch(upsert_into(folder, key, stamp, tie)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return snapshot(changes.sparkSession, folder).drop("bucket")


def slots(changes: DataFrame, stamp: str, width: str, late: str | None = "10 minutes") -> DataFrame:
    """ST05: events per fixed slot, emitted once when the watermark has passed the slot.

    ``late`` is None where ``changes`` has a watermark already, as ``replay_safe`` gives it.
    """
    return (changes.withWatermark(stamp, late) if late else changes).groupBy(F.window(stamp, width)).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("slot"), "events")
