"""Concept counts kept up to date by ticks of changed units, without counting the corpus again.

A tick takes units (id, revision, deleted, text). What was stored of a unit is taken back and what it holds
now is added, as signed differences of counts; deletions come first, so that a unit that is deleted and
put back in one tick is counted once. A unit whose fingerprint hasn't changed adds nothing, and counts are
written only if a difference is left. A deleted unit stays as a tombstone, so a late, older revision doesn't bring it back.

State lies in buckets of unit identifiers, of which a tick rewrites those that it touches, and in buckets of terms likewise.
A tick's folders bear its number; one that is run again after a failure reads the earlier ticks' folders
and overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.buckets import BUCKETS, Buckets
from quarry.operators.graphs import cut

_UNITS = "unit long, revision long, deleted boolean, fingerprint string, mentions array<struct<term:string,n:long>>"


class Discovery:
    """``mentions`` turns units (unit, text) into (unit, term, n)."""

    def __init__(self, spark: SparkSession, folder: str, mentions: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.mentions = mentions
        self.units = Buckets(spark, f"{folder}/units", _UNITS, "unit", buckets)
        self.totals = Buckets(spark, f"{folder}/counts", "term string, units long, uses long", "term", buckets)

    def counts(self) -> DataFrame:
        """(term, units, uses) of all units that are there."""
        return self.totals.read().filter("units > 0")

    def tick(self, number: int, changes: DataFrame) -> dict[str, int]:
        """Takes in ``changes`` (unit, revision, deleted, text) and tells how many units were written, deleted and left, and terms written."""
        # Of one unit's changes the newest acts; of one revision, the one that keeps the unit.
        newest = changes.groupBy("unit").agg(F.max(F.struct("revision", (~F.col("deleted")).alias("kept"), "text")).alias("c")).select("unit", "c.revision", (~F.col("c.kept")).alias("deleted"), "c.text")
        old = self.units.read(number).select("unit", F.col("revision").alias("old_revision"), F.col("deleted").alias("old_deleted"), F.col("fingerprint").alias("old_fingerprint"), F.col("mentions").alias("old_mentions"))
        fingerprint = F.when(~F.col("deleted"), F.sha2(F.coalesce("text", F.lit("")), 256))
        met = cut(newest.join(old, "unit", "left").withColumn("fingerprint", fingerprint).filter(F.col("old_revision").isNull() | (F.col("revision") > F.col("old_revision"))))
        same = F.col("old_fingerprint").eqNullSafe(F.col("fingerprint")) & F.col("old_deleted").eqNullSafe(F.col("deleted"))
        texts = met.filter(~F.col("deleted") & ~same).select("unit", "text")
        found = self.mentions(texts).groupBy("unit").agg(F.collect_list(F.struct("term", F.col("n").cast("long").alias("n"))).alias("found"))  # the terms of one unit
        none = F.expr("CAST(array() AS array<struct<term:string,n:long>>)")
        now = F.when(same, F.col("old_mentions")).when(F.col("deleted"), none).otherwise(F.coalesce("found", none))
        written = cut(met.join(found, "unit", "left").select("unit", "revision", "deleted", "fingerprint", now.alias("mentions"), same.alias("same"), F.coalesce("old_mentions", none).alias("old_mentions")))
        signed = lambda column, sign: written.filter("NOT same").select(F.explode(column).alias("m")).select("m.term", F.lit(sign).cast("long").alias("units"), (sign * F.col("m.n")).alias("uses"))
        deltas = signed("old_mentions", -1).unionByName(signed("mentions", 1)).groupBy("term").agg(F.sum("units").alias("units"), F.sum("uses").alias("uses")).filter("units <> 0 OR uses <> 0")
        deltas = cut(deltas)
        told = written.agg(F.count_if(~F.col("same") & ~F.col("deleted")).alias("written"), F.count_if(~F.col("same") & F.col("deleted")).alias("deleted"), F.count_if("same").alias("same")).first().asDict()
        told["terms"] = deltas.count()
        self.units.replace(number, written)
        self.totals.write(number, deltas, lambda stored, new: stored.unionByName(new).groupBy("term", "bucket").agg(F.sum("units").alias("units"), F.sum("uses").alias("uses")).filter("units <> 0 OR uses <> 0"))
        return told
