"""F31, ST05: calendar slots in a named zone, and jobs that come up once in each.

A plan has a cadence (INTERVAL, DAILY, WEEKLY, MONTHLY), a zone, and when in its period a job is due. Times
are UTC without a zone (``timestamp_ntz``), so results don't hang on the session's zone. A wall-clock time that a
change of clocks skips moves on by as much as is skipped; one that happens twice counts the first time. Before
a period's job is due there is no slot, and earlier periods are never caught up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CADENCES = ("INTERVAL", "DAILY", "WEEKLY", "MONTHLY")


@dataclass(frozen=True)
class Plan:
    """``weekday`` counts from Monday as 0; a day of the month is 28 at most, so that every month has it."""

    name: str
    cadence: str = "DAILY"
    zone: str = "UTC"
    hour: int = 0
    minute: int = 0
    weekday: int = 0
    month_day: int = 1
    seconds: int = 3600

    def __post_init__(self):
        ranges = ((self.hour, 0, 23), (self.minute, 0, 59), (self.weekday, 0, 6), (self.month_day, 1, 28), (self.seconds, 1, 86_400))
        if self.cadence not in CADENCES or any(not low <= x <= high for x, low, high in ranges):
            raise ValueError(f"no such schedule: {self}")


def utc(stamp: Column, zoned: bool) -> Column:
    """A timestamp as UTC without a zone; ``zoned`` tells a timestamp with the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp.cast("timestamp_ntz")) if zoned else stamp.cast("timestamp_ntz")


def slot(plan: Plan, stamp: Column) -> Column:
    """(period, due, following): the slot that a UTC time is in, null before it is due, and when the next one is due."""
    stamp = stamp.cast("timestamp_ntz")
    zone = F.lit(plan.zone)
    if plan.cadence == "INTERVAL":
        epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp)
        whole = epoch - F.when(F.timestamp_add("SECOND", epoch, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) > stamp, 1).otherwise(0)
        number = F.floor(whole / plan.seconds)
        at = lambda n: F.timestamp_add("SECOND", n * plan.seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        return F.struct(F.concat(F.lit(f"{plan.seconds}:"), number.cast("string")).alias("period"), at(number).alias("due"), at(number + 1).alias("following"))
    today = F.convert_timezone(F.lit("UTC"), zone, stamp).cast("date")
    monday = F.date_sub(today, F.weekday(today))
    if plan.cadence == "DAILY":
        day, after, period = today, F.date_add(today, 1), F.date_format(today, "yyyy-MM-dd")
    elif plan.cadence == "WEEKLY":
        day = F.date_add(monday, plan.weekday)
        after, period = F.date_add(day, 7), F.date_format(monday, "yyyy-MM-dd")
    else:
        day = F.date_add(F.trunc(today, "month"), plan.month_day - 1)
        after, period = F.add_months(day, 1), F.date_format(today, "yyyy-MM")
    wall = F.make_interval(hours=F.lit(plan.hour), mins=F.lit(plan.minute))
    to_utc = lambda d: F.convert_timezone(zone, F.lit("UTC"), d.cast("timestamp_ntz") + wall)
    due = to_utc(day)
    return F.struct(F.when(stamp >= due, period).alias("period"), due.alias("due"), to_utc(after).alias("following"))


def slots_of(rows: DataFrame, stamp: str, plans: Sequence[Plan]) -> DataFrame:
    """A row for each plan with the plan's name, and period, due and following of the row's slot; without rows that have none."""
    zoned = rows.schema[stamp].dataType.typeName() == "timestamp"
    made = F.array(*(F.struct(F.lit(p.name).alias("plan"), slot(p, utc(F.col(stamp), zoned)).alias("s")) for p in plans))
    out = rows.withColumn("_p", F.explode(made))
    return out.select(*rows.columns, F.col("_p.plan").alias("plan"), F.col("_p.s.period").alias("period"), F.col("_p.s.due").alias("due"), F.col("_p.s.following").alias("following")).filter("period IS NOT NULL")


def jobs(ticks: DataFrame, stamp: str, plans: Sequence[Plan], horizon: str = "32 days") -> DataFrame:
    """A stream of (job_key, plan, due): each slot's job once, whatever number of ticks falls into the slot.

    ``horizon`` is at least the longest period: a job's key is forgotten when no tick can be in its slot any more.
    """
    keyed = slots_of(ticks, stamp, plans).select(F.concat_ws(":", "plan", "period").alias("job_key"), "plan", F.col("due").cast("timestamp").alias("due"))
    return keyed.withWatermark("due", horizon).dropDuplicates(["job_key", "due"])
