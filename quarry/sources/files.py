"""Sources: validated JSON and CSV, office documents, subtitles, ontologies, format checks.

Files are read by Spark's own sources, so any file system that Spark knows will do; what has to be
unpacked is unpacked in tasks, one file at a time.
"""

from __future__ import annotations

import io
import re
import stat
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.window import Window

from quarry.operators.relational import unique_violations
from quarry.sources.sinks import parse_timestamp

UNIT_SCHEMA = "path string, seq long, locator string, level int, text string"


def json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC01: a file that is one array of records; a malformed record fails the scan."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def validated(df: DataFrame, keys: list[str]) -> DataFrame:
    """SRC02: ``df``, after a check that its keys are unique and not null."""
    bad = unique_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"keys {keys} are repeated or null: {[tuple(r)[:-1] for r in bad]}")
    return df


def complete(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """SRC07: ``df`` joined to ``known``, after a check that no key is missing there."""
    ids = known.select(F.col(known_key).alias(key)).distinct()
    missing = df.filter(F.col(key).isNotNull()).select(key).join(ids, key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"{key} refers to rows that aren't there: {[r[0] for r in missing]}")
    return df.join(known.withColumnRenamed(known_key, key), key, "left")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, text): the lines of text files, numbered from 0 in each file; LF, CR LF and CR end lines, a byte order mark is dropped.

    Files are read in splits, so one of any size is many tasks' work and no line is shuffled: a split's lines have
    consecutive ids, which become numbers once the lines of the splits before it are counted. The counting reads the files first.
    """
    # Both reads share one listing of the files, hence the same splits and ids.
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    begins = splits.select("path", "block", (before - F.col("first")).alias("shift"))
    placed = lines.join(begins, ["path", "block"]).withColumn("seq", F.col("id") + F.col("shift"))
    return placed.select("path", "seq", F.when(F.col("seq") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("text"))


def text_units(spark: SparkSession, path: str) -> DataFrame:
    """SRC22: a unit for every line that isn't blank, with its line number."""
    lines = numbered_lines(spark, path).filter("trim(text) <> ''")
    return lines.select("path", "seq", F.concat(F.lit("L"), (F.col("seq") + 1).cast("string")).alias("locator"), F.lit(None).cast("int").alias("level"), "text")


def sniffed_delimiter(sample: Column) -> Column:
    """SRC23: of comma, semicolon and tab, the one that the sample has most of; ties in that order."""
    count = lambda d: F.char_length(sample) - F.char_length(F.replace(sample, F.lit(d), F.lit("")))
    c, s, t = count(","), count(";"), count("\t")
    return F.when((c >= s) & (c >= t), ",").when(s >= t, ";").otherwise("\t")


def csv_units(spark: SparkSession, path: str) -> DataFrame:
    """SRC23: ``C1: v | C2: v`` for every row that isn't blank, the delimiter sniffed for each file."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for frame in frames:
            for file, text, mark in zip(frame["path"], frame["value"], frame["mark"]):
                rows = []
                reader = csv.reader(io.StringIO(text.removeprefix("\ufeff")), delimiter=mark)
                for n, row in enumerate(reader):
                    cells = [f"C{i}: {v.strip()}" for i, v in enumerate(row, 1) if v.strip()]
                    if cells:
                        rows.append((file, n, f"L{reader.line_num}", None, " | ".join(cells)))
                yield pd.DataFrame(rows, columns=["path", "seq", "locator", "level", "text"]).astype({"level": "Int32"})

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.withColumn("mark", sniffed_delimiter(F.substring("value", 1, 4096))).mapInPandas(run, UNIT_SCHEMA)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ET.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t").strip()


def docx_units(raw: bytes) -> Iterator[tuple[str, int | None, str]]:
    """SRC20: paragraphs with the outline level of their style, or of a style that it is based on, and table rows."""
    files = zipfile.ZipFile(io.BytesIO(raw))
    outline, base = {}, {}
    if "word/styles.xml" in files.namelist():
        for style in (x for x in ET.fromstring(files.read("word/styles.xml")) if _local(x.tag) == "style"):
            name = next(v for k, v in style.attrib.items() if _local(k) == "styleId")
            for x in style.iter():
                value = next((v for k, v in x.attrib.items() if _local(k) == "val"), None)
                if _local(x.tag) == "outlineLvl":
                    outline[name] = int(value) + 1
                elif _local(x.tag) == "basedOn":
                    base[name] = value

    def level(name: str | None, seen: int = 0) -> int | None:
        return outline.get(name, level(base.get(name), seen + 1) if name in base and seen < 16 else None)

    body = next(x for x in ET.fromstring(files.read("word/document.xml")) if _local(x.tag) == "body")
    for n, block in enumerate(body, 1):
        if _local(block.tag) == "p":
            marks = [(_local(x.tag), next((v for k, v in x.attrib.items() if _local(k) == "val"), None)) for x in block.iter()]
            own = next((int(v) + 1 for t, v in marks if t == "outlineLvl"), None)
            yield f"P{n}", own or level(next((v for t, v in marks if t == "pStyle"), None)), _texts(block)
        elif _local(block.tag) == "tbl":
            for r, row in enumerate((x for x in block if _local(x.tag) == "tr"), 1):
                yield f"T{n}R{r}", None, " | ".join(_texts(c) for c in row if _local(c.tag) == "tc")


def xlsx_units(raw: bytes) -> Iterator[tuple[str, int | None, str]]:
    """SRC21: ``A1: v | B1: v`` for every row of every sheet; a formula without a stored value is marked."""
    files = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in files.namelist():
        shared = [_texts(x) for x in ET.fromstring(files.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"]
    for name in sorted(n for n in files.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for row in (x for x in ET.fromstring(files.read(name)).iter() if _local(x.tag) == "row"):
            cells = []
            for cell in (x for x in row if _local(x.tag) == "c"):
                parts = {_local(x.tag): x for x in cell}
                value = parts["v"].text if "v" in parts else _texts(cell)
                if cell.get("t") == "s" and value:
                    value = shared[int(value)]
                if not value and "f" in parts:
                    value = "[formula not calculated]"
                if value and value.strip():
                    cells.append(f"{cell.get('r')}: {value.strip()}")
            if cells:
                yield f"{name[14:-4]}R{row.get('r')}", None, " | ".join(cells)


def pptx_units(raw: bytes) -> Iterator[tuple[str, int | None, str]]:
    """SRC24: shapes of each slide by top, left and id; tables a row at a time."""
    files = zipfile.ZipFile(io.BytesIO(raw))
    names = [n for n in files.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    for name in sorted(names, key=lambda n: int(re.findall(r"\d+", n)[0])):
        shapes = []
        for shape in ET.fromstring(files.read(name)).iter():
            if _local(shape.tag) in ("sp", "graphicFrame"):
                off = next((x for x in shape.iter() if _local(x.tag) == "off"), None)
                number = next((int(x.get("id", 0)) for x in shape.iter() if _local(x.tag) == "cNvPr"), 0)
                shapes.append((int(off.get("y", 0)) if off is not None else 0, int(off.get("x", 0)) if off is not None else 0, number, shape))
        for *_, number, shape in sorted(shapes, key=lambda s: s[:3]):
            rows = [x for x in shape.iter() if _local(x.tag) == "tr"]
            if rows:
                for r, row in enumerate(rows, 1):
                    yield f"{name[11:-4]}S{number}R{r}", None, " | ".join(_texts(c) for c in row if _local(c.tag) == "tc")
            else:
                yield f"{name[11:-4]}S{number}", None, "\n".join(filter(None, (_texts(p) for p in shape.iter() if _local(p.tag) == "p")))


_READERS = {"docx": docx_units, "xlsx": xlsx_units, "pptx": pptx_units}


def office_units(spark: SparkSession, path: str) -> DataFrame:
    """SRC20, SRC21, SRC24, SRC25: units of office files by their suffix; a broken file gives one unit of level -1 that says why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, raw in zip(frame["path"], frame["content"]):
                try:
                    units = [u for u in _READERS[file.rpartition(".")[2].lower()](bytes(raw)) if u[2]]
                except (KeyError, ValueError, StopIteration, zipfile.BadZipFile, ET.ParseError) as error:
                    units = [("", -1, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame([(file, n, *u) for n, u in enumerate(units)], columns=["path", "seq", "locator", "level", "text"]).astype({"level": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.filter(F.lower("path").rlike(r"\.(docx|xlsx|pptx)$")).mapInPandas(run, UNIT_SCHEMA)


def with_offsets(units: DataFrame, most: int | None = None) -> DataFrame:
    """SRC25, W11: start of every unit in its file's text, units being two characters apart; ``most`` splits longer ones."""
    if most:
        n = F.ceil(F.char_length("text") / most).cast("int")
        units = units.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))).withColumn("text", F.expr(f"substring(text, _k * {most} + 1, {most})"))
    else:
        units = units.withColumn("_k", F.lit(0))
    before = F.sum(F.char_length("text") + 2).over(Window.partitionBy("path").orderBy("seq", "_k").rowsBetween(Window.unboundedPreceding, -1))
    return units.withColumn("start", F.coalesce(before, F.lit(0))).drop("_k")


def parse_srt(df: DataFrame, key: str, text: str) -> DataFrame:
    """SRC28: (key, cue, start_ms, end_ms, text) of subtitle documents; blocks without a time line are left out."""
    blocks = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"\n[ \t]*\n+")
    rows = df.select(key, F.posexplode(blocks).alias("cue", "block"))
    line = r"(\d+:\d\d:\d\d[,.]\d{3})\s*-->\s*(\d+:\d\d:\d\d[,.]\d{3})[^\n]*\n?([\s\S]*)"
    part = [F.regexp_extract("block", line, i) for i in (1, 2, 3)]
    return rows.filter(F.col("block").rlike(line)).select(key, "cue", parse_timestamp(part[0]).alias("start_ms"), parse_timestamp(part[1]).alias("end_ms"), F.trim(part[2]).alias("text"))


#: How external relations are called here; the third one only where languages are equal.
WIKIDATA = {"P279": "broader", "P31": "related"}
CONCEPTNET = {"Synonym": "equivalent", "IsA": "broader", "RelatedTo": "related"}
LANGUAGES = ("vi", "en")


def conceptnet_edges(df: DataFrame) -> DataFrame:
    """SRC31: (src, dst, relation) from edges (start, start_language, end, end_language, rel).

    A synonym of another language is a translation. Other relations and languages are left out.
    """
    known = F.create_map(*(F.lit(x) for kv in CONCEPTNET.items() for x in kv))
    relation = F.when((F.col("rel") == "Synonym") & (F.col("start_language") != F.col("end_language")), "translation").otherwise(F.try_element_at(known, F.col("rel")))
    rows = df.filter(F.col("start_language").isin(*LANGUAGES) & F.col("end_language").isin(*LANGUAGES))
    return rows.select(F.col("start").alias("src"), F.col("end").alias("dst"), relation.alias("relation")).filter("relation IS NOT NULL")


def wikidata_edges(df: DataFrame) -> DataFrame:
    """SRC31: (src, dst, relation) from entities (id, claims map<string, array<string>>)."""
    known = F.create_map(*(F.lit(x) for kv in WIKIDATA.items() for x in kv))
    claims = df.select(F.col("id").alias("src"), F.explode("claims").alias("p", "targets"))
    return claims.select("src", F.explode("targets").alias("dst"), F.try_element_at(known, F.col("p")).alias("relation")).filter("relation IS NOT NULL")


#: The most entries of an archive and the most bytes that they unpack to.
ARCHIVE_ENTRIES, ARCHIVE_BYTES = 2000, 64 << 20


@F.pandas_udf(StringType())
def archive_verdict(contents: pd.Series) -> pd.Series:
    """SRC32: what is wrong with a ZIP archive, from its directory alone; nothing is unpacked."""

    def one(raw) -> str | None:
        try:
            entries = zipfile.ZipFile(io.BytesIO(raw)).infolist()
        except (zipfile.BadZipFile, ValueError, OSError):
            return "BROKEN_ARCHIVE"
        names = [PurePosixPath(e.filename.replace("\\", "/")) for e in entries]
        if len(entries) > ARCHIVE_ENTRIES or sum(e.file_size for e in entries) > ARCHIVE_BYTES:
            return "ARCHIVE_TOO_LARGE"
        if any(n.is_absolute() or ".." in n.parts or ":" in n.parts[0] for n in names if n.parts) or any(stat.S_ISLNK(e.external_attr >> 16) for e in entries):
            return "UNSAFE_ARCHIVE"
        if any(e.flag_bits & 1 for e in entries):
            return "ENCRYPTED"
        if any("vbaproject" in e.filename.lower() for e in entries):
            return "HAS_MACROS"
        return None

    return contents.map(one)


def format_check(files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """SRC32: (path, verdict) from extension, size and first bytes of binary files (path, length, content), and from the directory of archives."""
    #: First bytes by extension.
    magic = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304", "zip": "504B0304"}
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    wanted = F.try_element_at(F.create_map(*(F.lit(x) for kv in magic.items() for x in kv)), ext)
    plain = ext.isin("txt", "csv", "srt")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    verdict = (
        F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > most_bytes, "TOO_LARGE").when(wanted.isNull() & ~plain, "UNKNOWN_TYPE")
        .when(plain & (text.isNull() | F.contains(text, F.lit("\0"))), "NOT_TEXT").when(wanted.isNotNull() & ~head.startswith(wanted), "WRONG_SIGNATURE").otherwise("OK")
    )
    archive = (verdict == "OK") & ext.isin("docx", "xlsx", "pptx", "zip")
    return files.select("path", F.when(archive, F.coalesce(archive_verdict(F.when(archive, F.col("content"))), F.lit("OK"))).otherwise(verdict).alias("verdict"))
