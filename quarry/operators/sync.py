"""Reconciliation and synchronisation operators: fingerprints, record flags, retire plans, histories."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.graphs import cut
from quarry.operators.relational import different_fields, differs, prefix_sums


def row_digest(key: str, stamp: str) -> Column:
    """md5 of ``id:timestamp`` with the timestamp in UTC to the second."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")))


def ordered_digest(rows: DataFrame, order: Sequence[str], digest: str, join: Callable[[Column], Column], by: str | None = None, stretch: int = 4096) -> DataFrame:
    """([by,] n, digest): one digest of all rows in order, as a tree: ``stretch`` rows by rank are joined, then as many of those, until one is left.

    Ranks come from range sums (``prefix_sums``), so sparse keys fill stretches like dense ones, and no list has more
    than ``stretch`` entries. ``join`` makes a digest of an ordered list of digests. Rows of equal ``order`` are ordered by digest.
    """
    keys = [by] if by else []
    ranked = prefix_sums(rows.select(*keys, *order, F.col(digest).alias("d"), F.lit(1).alias("one")), [*keys, *order, "d"], ["one"])
    if by:
        first = ranked.groupBy(by).agg(F.min("one_sum").alias("first"))
        ranked = ranked.join(first, by).withColumn("one_sum", F.col("one_sum") - F.col("first") + 1)
    level = ranked.select(*keys, (F.col("one_sum") - 1).alias("at"), F.col("one").cast("long").alias("n"), "d")
    while True:
        place = F.expr(f"at DIV {stretch}").alias("place")
        level = level.groupBy(*keys, place).agg(F.sum("n").alias("n"), join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x.d)).alias("d"))
        level = cut(level.withColumnRenamed("place", "at"))
        if level.filter("at > 0").isEmpty():
            return level.select(*keys, "n", F.col("d").alias("digest"))


def table_summary(df: DataFrame, key: str, stamp: str, size: str, stretch: int = 4096) -> DataFrame:
    """Count, key range, newest stamp, bytes and the order-sensitive fingerprint of a table, a tree of digests by rank of the key."""
    rows = df.select(F.col(key).alias("k"), F.col(stamp).alias("s"), F.col(size).alias("b"), row_digest(key, stamp).alias("d"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_id"), F.max("k").alias("last_id"), F.max("s").alias("newest"), F.sum("b").alias("bytes"))
    digest = ordered_digest(rows, ["k"], "d", lambda listed: F.md5(F.array_join(listed, "")), stretch=stretch).select(F.col("digest").alias("d"))
    both = out.join(F.broadcast(digest), F.lit(True), "left")  # one row each
    return both.select("n", "first_id", "last_id", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), F.round("bytes", 2).alias("bytes"), F.coalesce("d", F.lit("")).alias("fingerprint"))


def bucket_summary(df: DataFrame, key: str, stamp: str, buckets: int = 64) -> DataFrame:
    """A06, mergeable: per bucket of keys, the row count and two order-free sums of row digests."""
    digest = F.conv(F.substring(row_digest(key, stamp), 1, 12), 16, 10).cast("long")
    return df.groupBy(F.pmod(F.col(key), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("digest_sum"), F.bit_xor(digest).alias("digest_xor"))


def record_flags(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], stored: str, local: Column, authoritative: bool = True) -> DataFrame:
    """One flag per key of the full outer join, in the order of precedence.

    ``stored`` names the target's stored digest of ``columns``; ``local`` marks target rows to skip.
    """
    actual = F.md5(F.concat_ws("|", *(F.coalesce(F.col(f"t.{c}").cast("string"), F.lit("")) for c in columns)))
    joined = source.alias("s").join(target.alias("t"), F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")
    flag = (
        F.when(F.col(f"t.{key}").isNull(), "ORPHAN_SOURCE")
        .when(local, "LOCAL")
        .when(F.col(f"s.{key}").isNull(), "ORPHAN_MASTER" if authoritative else "NOT_VERIFIED")
        .when(F.col(f"t.{stored}") != actual, "MUTATED_DOWNSTREAM")
        .when(differs(columns), "DESYNC_METADATA")
        .otherwise("MATCHED")
    )
    fields = F.when(flag == "DESYNC_METADATA", F.array_join(different_fields(columns), ",")).otherwise("")
    return joined.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), flag.alias("flag"), fields.alias("fields"))


def discrepancy_report(flags: DataFrame, limit: float = 0.1) -> DataFrame:
    """A10: counts per flag, the mismatch ratio over the larger side, and the run's status."""
    counted = flags.filter("flag <> 'LOCAL'").agg(
        F.count_if(F.col("flag") == "MATCHED").alias("matched"), F.count_if(~F.col("flag").isin("MATCHED", "NOT_VERIFIED")).alias("mismatched"), F.count_if(F.col("flag") == "NOT_VERIFIED").alias("unverified"),
        F.greatest(F.count_if(F.col("flag") != "ORPHAN_MASTER"), F.count_if(F.col("flag") != "ORPHAN_SOURCE"), F.lit(1)).alias("larger"),
    )
    ratio = F.round(F.col("mismatched") / F.col("larger"), 6)
    status = F.when(ratio > limit, "BLOCKED").when(F.col("unverified") > 0, "PARTIAL").otherwise("COMPLETED")
    return counted.select("matched", "mismatched", "unverified", ratio.alias("mismatch_ratio"), status.alias("status"))


def retire_plan(target: DataFrame, source: DataFrame, key: str, active: Column, origin: Column, ratio: float = 0.1, most: int = 100) -> DataFrame:
    """Rows missing in the source, inactive ones counted apart, and whether a guard blocks the plan."""
    marked = target.select(key, active.alias("active"), origin.alias("origin")).join(source.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    managed = F.col("origin") == "SOURCE"
    counted = marked.agg(
        F.count_if(managed).alias("managed"), F.count_if(F.col("_k").isNotNull()).alias("present"),
        F.count_if(managed & F.col("_k").isNull() & F.col("active")).alias("candidates"), F.count_if(managed & F.col("_k").isNull() & ~F.col("active")).alias("already_inactive"),
    )
    blocked = (F.col("present") == 0) | (F.col("candidates") / F.greatest("managed", F.lit(1)) > ratio) | (F.col("candidates") > most)
    return counted.withColumn("blocked", blocked)


def failure_streak(runs: DataFrame, key: str, order: Sequence[Column], failed: Column) -> DataFrame:
    """How many of each key's newest runs failed before the first that didn't."""
    window = Window.partitionBy(key).orderBy(*order)
    good = F.sum(F.when(failed, 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("_good", good).groupBy(key).agg(F.count_if(F.col("_good") == 0).alias("streak"))


def latest_revision(events: DataFrame, key: str, revision: str, priority: str) -> DataFrame:
    """M16, SNK11: each key's event of the highest revision; of equal revisions, the higher priority."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(revision).alias("revision"), F.col(priority).alias("kind"))).alias("e")).select(key, "e.revision", "e.kind")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, gap: float, longest: float) -> DataFrame:
    """SRC29: joins an interval to the one before if the gap and the joined length allow it.

    The length rule depends on what was joined before, so it is a fold over each key's own list.
    """
    item = F.struct(F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("b"))
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("l"))
    empty = F.expr("CAST(array() AS array<struct<a:double,b:double>>)")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (x.a - last.b <= gap) & (F.greatest(last.b, x.b) - last.a <= longest)
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last.a.alias("a"), F.greatest(last.b, x.b).alias("b"))))
        return F.when(joins, joined).otherwise(F.concat(acc, F.array(F.struct(x.a.alias("a"), x.b.alias("b")))))

    return listed.select(key, F.inline(F.aggregate("l", empty, step))).withColumnsRenamed({"a": "start", "b": "end"})


def slot_key(stamp: str, seconds: int) -> Column:
    """F31, ST05: the key of the fixed-interval slot that a timestamp is in."""
    epoch = F.unix_timestamp(F.col(stamp).cast("timestamp"))
    return F.concat(F.lit(f"{seconds}:"), F.floor(epoch / seconds).cast("string"))


def backoff(attempt: Column, base: int = 30, most: int = 3600) -> Column:
    """doubling delay in seconds, capped."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))


def claim(queue: DataFrame, capacity: int, order: Sequence[Column], eligible: Column) -> DataFrame:
    """ST04 as a batch: the oldest eligible rows up to the capacity."""
    return queue.filter(eligible).orderBy(*order).limit(capacity)
