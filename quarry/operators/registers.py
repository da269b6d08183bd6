"""SNK10, SNK14: registers that are updated by compare-and-set, and sequences handed out from stored counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.buckets import BUCKETS, Buckets
from quarry.operators.graphs import cut
from quarry.operators.relational import prefix_sums

OUTCOMES = ("APPLIED", "CONFLICT", "MISSING")


class Registers:
    """(id, revision, value) under a folder. An update states the revision that it was made for, and acts only if that is still the register's."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.table = Buckets(spark, folder, "id long, revision long, value string", "id", buckets)

    def put(self, number: int, rows: DataFrame) -> None:
        """New registers (id, value) at revision 0; those that are there stay as they are."""
        self.table.write(number, rows.select("id", F.lit(0).cast("long").alias("revision"), "value").dropDuplicates(["id"]), lambda stored, new: stored.unionByName(new.join(stored.select("id"), "id", "left_anti").select(*stored.columns)))

    def update(self, number: int, updates: DataFrame) -> DataFrame:
        """Runs ``updates`` (id, place, expected, value) as if one after the other by place; gives (id, place, outcome).

        A register's updates can't all be listed in one task, so each round applies the first update beyond the last applied one that
        expects the revision reached; there are as many rounds as the register with most successes needs.
        """
        stored = self.table.read(number)
        now = cut(stored.join(updates.select("id").distinct(), "id").select("id", "revision", "value", F.lit(None).cast("long").alias("last")))
        updates = cut(updates.select("id", "place", "expected", "value"))
        applied = None
        while True:
            open_ = updates.join(now.select("id", "revision", "last"), "id").filter((F.col("expected") == F.col("revision")) & (F.col("last").isNull() | (F.col("place") > F.col("last"))))
            won = cut(open_.groupBy("id").agg(F.min(F.struct("place", "value")).alias("w")).select("id", F.col("w.place").alias("place"), F.col("w.value").alias("new")))
            if won.isEmpty():
                break
            applied = won.select("id", "place") if applied is None else applied.unionByName(won.select("id", "place"))
            joined = now.join(won, "id", "left")
            now = cut(joined.select("id", F.when(F.col("place").isNotNull(), F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(F.col("place").isNotNull(), F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce("place", "last").alias("last")))
        self.table.replace(number, now.filter("last IS NOT NULL"))
        known = now.select("id", F.lit(True).alias("known"))
        marked = updates.join(known, "id", "left")
        marked = marked.join(applied.withColumn("won", F.lit(True)), ["id", "place"], "left") if applied is not None else marked.withColumn("won", F.lit(None).cast("boolean"))
        return marked.select("id", "place", F.when(F.col("won"), "APPLIED").when(F.col("known"), "CONFLICT").otherwise("MISSING").alias("outcome"))


class Sequences:
    """Counters (scope, last) under a folder, from which numbers are handed out in order, up to ``most`` in each scope."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 99_999, buckets: int = BUCKETS):
        self.most, self.table = most, Buckets(spark, folder, "scope string, last long", "scope", buckets)

    def allocate(self, number: int, requests: DataFrame, key: str) -> DataFrame:
        """(scope, key, seq) for ``requests`` (scope, key), in the order of their keys; null where the scope has no numbers left.

        Ranks come from range sums, so a scope of most requests is spread. A batch that is run again gets the same numbers.
        """
        # A running count over all requests; what lies before a scope's first is taken off.
        counted = prefix_sums(requests.select("scope", key).withColumn("one", F.lit(1).cast("long")), ["scope", key], ["one"])
        first = counted.groupBy("scope").agg(F.min("one_sum").alias("first"), F.count(F.lit(1)).alias("n"))
        last = self.table.read(number)
        base = first.join(last, "scope", "left").select("scope", "first", "n", F.coalesce("last", F.lit(0)).cast("long").alias("last"))
        base = cut(base)
        given = cut(counted.join(base, "scope").withColumn("seq", F.col("last") + F.col("one_sum") - F.col("first") + 1))
        self.table.replace(number, base.select("scope", F.least(F.col("last") + F.col("n"), F.lit(self.most)).alias("last")))
        return given.select("scope", key, F.when(F.col("seq") <= self.most, F.col("seq")).alias("seq"))
