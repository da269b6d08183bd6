"""Report sinks: formula-safe CSV cells and subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_formula(cell: Column) -> Column:
    """SNK17: a leading apostrophe where a spreadsheet would read a formula."""
    return F.when(F.ltrim(cell).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def write_report(df: DataFrame, path: str) -> None:
    """SNK17: CSV with every string cell escaped."""
    safe = [escape_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.option("header", True).csv(path)


def timestamp(ms: Column, mark: str) -> Column:
    """``HH:MM:SS,mmm`` with the subtitle format's decimal mark."""
    ms = ms.cast("long")
    parts = [F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000]
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", *(p.cast("int") for p in parts))


def parse_timestamp(text: Column) -> Column:
    """milliseconds of a subtitle timestamp, null where it is none."""
    pattern = r"^(\d+):(\d\d):(\d\d)[,.](\d{3})$"
    part = [F.regexp_extract(text, pattern, i).try_cast("long") for i in range(1, 5)]
    return ((part[0] * 60 + part[1]) * 60 + part[2]) * 1000 + part[3]


def subtitles(segments: DataFrame, key: str, order: str, start: str, end: str, text: str, kind: str = "srt") -> DataFrame:
    """SNK18: one document per key from its segments in order, as ``srt``, ``vtt`` or plain ``txt``."""
    if kind == "txt":
        rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("xs"))
        return rows.select(key, F.array_join(F.transform("xs", lambda x: x.t), "\n").alias("document"))
    mark = "," if kind == "srt" else "."
    line = F.concat(timestamp(F.col(start), mark), F.lit(" --> "), timestamp(F.col(end), mark), F.lit("\n"), F.coalesce(text, F.lit("")))
    rows = segments.select(key, F.struct(F.col(order).alias("o"), line.alias("l")).alias("x"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    numbered = F.transform("xs", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x.l))
    body = F.array_join(numbered if kind == "srt" else F.transform("xs", lambda x: x.l), "\n\n")
    return listed.select(key, (body if kind == "srt" else F.concat(F.lit("WEBVTT\n\n"), body)).alias("document"))
