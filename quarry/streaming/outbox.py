"""ST07, SNK19: an outbox that delivers each event once in effect, with retries.

``foreachBatch`` hands over events at least once. Batch n writes two folders of its own: ``effects/batch=n``, what
it has delivered, and ``pending/batch=n``, all that still waits, with attempts and due time. A batch reads the
folders of earlier batches only, so one that is run again after a failure overwrites what it had written, and
an event that any earlier batch delivered or keeps waiting is passed over. Effects are sorted by the
event's time; a replayed event has the time it had before, so files and row groups of other times are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.graphs import cut

#: The longest delay in seconds, and the greatest power of two before it.
LONGEST, POWER = 300, 8


def delay(attempts: Column) -> Column:
    """Seconds until the next attempt after so many: min(300, 2 ** min(attempts, 8))."""
    return F.least(F.lit(LONGEST), F.pow(F.lit(2), F.least(attempts, F.lit(POWER)))).cast("long")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers in the names of the folders under ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    return sorted(int(n.split("=", 1)[1]) for n in names if "=" in n)


class Outbox:
    """``delivers`` tells from an event's columns and ``attempt`` (from 1) whether the target takes it."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, stamp: str, delivers: Callable[[Column], Column]):
        self.spark, self.folder, self.key, self.stamp, self.delivers = spark, folder, key, stamp, delivers
        # Clocks are whole seconds of event time: when an event was first seen, and when it is due again.
        self.columns = T.StructType([*schema.fields, T.StructField("attempts", T.IntegerType()), T.StructField("first_at", T.LongType()), T.StructField("due", T.LongType())])

    def _read(self, kind: str, extra: str) -> DataFrame:
        schema = T.StructType([*self.columns.fields, *T._parse_datatype_string(extra).fields])
        path = f"{self.folder}/{kind}"
        return self.spark.read.schema(schema).parquet(path) if _numbers(self.spark, path) else self.spark.createDataFrame([], schema)

    def effects(self) -> DataFrame:
        """Delivered events with the attempts that they took, and when they were first seen and delivered (``due``)."""
        return self._read("effects", "batch long, round int").drop("batch", "round")

    def _last(self, before: int | None = None) -> tuple[int, int] | None:
        """The last batch (below ``before``) and its last round."""
        batches = [n for n in _numbers(self.spark, f"{self.folder}/pending") if before is None or n < before]
        return (batches[-1], _numbers(self.spark, f"{self.folder}/pending/batch={batches[-1]}")[-1]) if batches else None

    def pending(self, before: int | None = None) -> DataFrame:
        """What waits after the last batch (below ``before``), which may be nothing."""
        last = self._last(before)
        if last is None:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(f"{self.folder}/pending/batch={last[0]}/round={last[1]}")

    def _attempt(self, due: DataFrame, later: DataFrame, clock: int, batch: int, round_: int, fail_before_commit: bool = False) -> None:
        # Whether an event gets through is decided once, and both folders follow from it.
        tried = cut(due.withColumn("attempts", F.col("attempts") + 1).withColumn("ok", self.delivers(F.col("attempts"))))
        at = F.lit(clock).cast("long")
        done = tried.filter("ok").withColumn("due", at).drop("ok")
        done.sortWithinPartitions(self.stamp).write.mode("overwrite").parquet(f"{self.folder}/effects/batch={batch}/round={round_}")
        if fail_before_commit:
            raise RuntimeError("stopped between the effects and the ledger")
        waits = tried.filter("NOT ok").withColumn("due", at + delay(F.col("attempts"))).drop("ok").unionByName(later)
        waits.write.mode("overwrite").parquet(f"{self.folder}/pending/batch={batch}/round={round_}")

    def write(self, events: DataFrame, batch: int, fail_before_commit: bool = False) -> None:
        """The batch writer: new events, and those that wait and are due by the newest event's time."""
        self.spark = events.sparkSession
        clock = F.unix_timestamp(F.col(self.stamp).cast("timestamp"))
        first, last, clock = events.agg(F.min(self.stamp), F.max(self.stamp), F.max(clock)).first()
        if clock is None:
            return
        new = events.dropDuplicates([self.key])
        sent = self._read("effects", "batch long, round int").filter(F.col("batch") < batch).filter(F.col(self.stamp).between(F.lit(first), F.lit(last))).select(self.key)
        waits = self.pending(batch)
        new = new.join(sent, self.key, "left_anti").join(waits.select(self.key), self.key, "left_anti")
        fresh = new.select(*(F.col(c) for c in events.columns), F.lit(0).alias("attempts"), F.unix_timestamp(F.col(self.stamp).cast("timestamp")).alias("first_at"), F.lit(None).cast("long").alias("due"))
        self._attempt(fresh.unionByName(waits.filter(F.col("due") <= clock)), waits.filter(F.col("due") > clock), clock, batch, 0, fail_before_commit)

    def drain(self, most_rounds: int = 64) -> int:
        """Goes on after the last batch until nothing waits, each round at the time when all that waits is due; gives the rounds."""
        for n in range(1, most_rounds + 1):
            waits = self.pending()
            clock = waits.agg(F.max("due")).first()[0]
            if clock is None:
                return n - 1
            batch, round_ = self._last()
            self._attempt(waits, waits.filter("false"), clock, batch, round_ + 1)
        return most_rounds

    def run(self, events: DataFrame, checkpoint: str) -> None:
        """Everything that the stream ``events`` has now."""
        events.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
