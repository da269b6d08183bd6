"""Relational operators: ranking, paging, lookups, upserts and set comparison.

All are DataFrame to DataFrame and total in their order, so results never depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.graphs import cut


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each key; filter for eligibility before, not after."""
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(place) <= n)


def with_history(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: str = "history") -> DataFrame:
    """The latest row of each key with the number of its rows."""
    counted = df.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return latest_by(counted, keys, order).drop("place")


def mode_pick(df: DataFrame, key: str, values: Sequence[str], fresh: str) -> DataFrame:
    """Each key's most frequent value tuple; ties by freshness (nulls last), then values descending."""
    groups = df.groupBy(key, *values).agg(F.count(F.lit(1)).alias("n"), F.max(fresh).alias("fresh"))
    order = [F.desc("n"), F.desc_nulls_last("fresh"), *(F.desc(v) for v in values)]
    return latest_by(groups, [key], order).select(key, *values, "n", "fresh")


def keyset_after(df: DataFrame, stamp: str, key: str, after: Column, last: Column) -> DataFrame:
    """SRC04, L02: rows after a (timestamp, key) cursor; structs order lexicographically."""
    return df.filter(F.struct(F.col(stamp).alias("a"), F.col(key).alias("b")) > F.struct(after.alias("a"), last.alias("b")))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Offset paging over a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page whose every row carries the unpaged total; an empty page keeps one row with it."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = page(df, order, limit, offset)
    return F.broadcast(total).join(rows, F.lit(True), "left")


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC02: keys that occur more than once, or are null."""
    nulls = F.col(keys[0]).isNull()
    for k in keys[1:]:
        nulls = nulls | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | nulls)


def grouped_lookup(df: DataFrame, key: str, child: DataFrame, child_key: str, count: str = "n") -> DataFrame:
    """Left join to a grouped count, absent meaning zero."""
    counts = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(count))
    return df.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def differs(columns: Sequence[str], left: str = "s", right: str = "t") -> Column:
    """Whether any column differs, nulls being equal to each other."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def different_fields(columns: Sequence[str], left: str = "s", right: str = "t") -> Column:
    """The names of the columns that differ, in the given order."""
    flags = [F.when(~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")), F.lit(c)) for c in columns]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def upsert_actions(source: DataFrame, target: DataFrame, key: str, updated: str, columns: Sequence[str], sticky: Sequence[str] = ()) -> DataFrame:
    """SNK01: INSERTED, UPDATED or SKIPPED per source row, with the merged values.

    A source row older than the target's is skipped. A null never clears a sticky column, and a
    sticky conflict is an ERROR. Rows equal in all compared columns are skipped.
    """
    s, t = source.alias("s"), target.alias("t")
    joined = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "left")
    absent = F.col(f"t.{key}").isNull()
    value = {c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")) if c in sticky else F.col(f"s.{c}") for c in columns}
    changed = F.lit(False)
    conflict = F.lit(False)
    for c in columns:
        changed = changed | ~value[c].eqNullSafe(F.col(f"t.{c}"))
        if c in sticky:
            conflict = conflict | F.coalesce(F.col(f"s.{c}") != F.col(f"t.{c}"), F.lit(False))
    older = F.col(f"s.{updated}") < F.col(f"t.{updated}")
    action = F.when(absent, "INSERTED").when(conflict, "ERROR").when(older, "SKIPPED").when(changed, "UPDATED").otherwise("SKIPPED")
    keep = (action == "SKIPPED") & ~absent | (action == "ERROR")
    merged = [F.when(keep, F.col(f"t.{c}")).otherwise(value[c]).alias(c) for c in columns]
    return joined.select(F.col(f"s.{key}").alias(key), action.alias("action"), *merged)


def replaced_relations(source: DataFrame, target: DataFrame, parent: str, child: str) -> DataFrame:
    """SNK03, R07: parents whose set of children differs between source and target."""
    sets = [d.groupBy(parent).agg(F.array_sort(F.collect_set(child)).alias(n)) for d, n in ((source, "new"), (target, "old"))]
    return sets[0].join(sets[1], parent, "full_outer").filter(~F.col("new").eqNullSafe(F.col("old")))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows to add and rows to remove to turn ``right`` into ``left``."""
    add = left.subtract(right).withColumn("change", F.lit("add"))
    return add.unionByName(right.subtract(left).withColumn("change", F.lit("remove")))


def like_literal(term: str) -> str:
    """A contains-pattern in which backslash, percent and underscore stand for themselves."""
    for c in "\\%_":
        term = term.replace(c, f"\\{c}")
    return f"%{term}%"


def prefix_sums(df: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` with the running sum of each value in order, as ``<value>_sum``, and no task that has all rows.

    Ranges of rows are summed up apart, and each gets the totals of the ranges before it, of which
    there are as many as partitions. ``order`` is unique.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values))
    starts = totals.select("_range", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}_before") for v in values))
    summed = ranged.select(*ranged.columns, *(F.sum(v).over(inner).alias(f"_{v}_here") for v in values)).join(starts, "_range")
    return summed.select(*df.columns, *((F.col(f"_{v}_here") + F.col(f"_{v}_before")).alias(f"{v}_sum") for v in values))
