"""Shared-folder staging and vectorised byte, word and hash helpers.

Null texts count as empty everywhere. Arrow batches are cut into slices of a fixed number of
bytes, so that the numpy work arrays stay small whatever the batch size.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text for which numpy work arrays are built at a time.
SLICE_BYTES = 1 << 19

_U = np.uint64
_own_root: list[str] = []


def run_folder(spark: SparkSession) -> str:
    """The application's own folder in the one that the cluster shares (``spark.checkpoint.dir``).

    Where that is unset, a local master gets a folder of its own, removed at exit; a cluster uses
    its warehouse, which executors share by contract.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.startswith("local[") or not root and spark.sparkContext.master == "local":
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="quarry-"))
            atexit.register(shutil.rmtree, _own_root[0], True)
        root = f"file://{_own_root[0]}"
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the application's folder."""
    return f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that the application has staged; for the end of a job, when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def ascii_lower(col):
    """Lower-cases A-Z alone, whatever the locale and collation."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of the filters that rows are asked against, whatever the number of values.
FILTER_BITS = 24


def _place(value: Column) -> tuple[Column, Column]:
    """The filter's word and bit of a value."""
    slot = F.shiftrightunsigned(F.xxhash64(value), 64 - FILTER_BITS)
    return F.shiftright(slot, 6), (slot % 64).cast("int")


def bit_filter(values: DataFrame, column: str) -> DataFrame:
    """(word, bits): at most 2**FILTER_BITS bits that say which values there may be."""
    word, bit = _place(F.col(column))
    return staged(values.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "filter")


def asked(rows: DataFrame, value: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``value`` the filter lets through (all that it was made of, and a few others), and the rest; neither is moved."""
    word, bit = _place(value)
    named = distinct_name(rows, "filter_word")
    held = distinct_name(rows, "filter_bits")
    # A filter's size is fixed: 2**(FILTER_BITS - 6) words.
    known = F.broadcast(bits.select(F.col("word").alias(named), F.col("bits").alias(held)))
    met = rows.withColumn(named, word).join(known, named, "left")
    through = F.coalesce(F.call_function("shiftright", F.col(held), bit).bitwiseAND(F.lit(1)), F.lit(0)) == 1
    return met.filter(through).select(*rows.columns), met.filter(~through).select(*rows.columns)


def without_lost(docs: DataFrame, lost: DataFrame, id_col: str, text: Column, nulls: bool) -> DataFrame:
    """``docs`` without the rows that ``lost`` (lost_id, lost_text) names by identifier and a digest of their ``text``.

    Only rows whose identifier a filter of fixed size lets through are digested and compared; the
    others stay where they are. With ``nulls``, null equals null.
    """
    names = {c: distinct_name(docs, c) for c in ("lost_id", "lost_text")}
    lost = staged(lost.distinct(), "lost")
    maybe, clean = asked(docs, F.col(id_col), bit_filter(lost, "lost_id"))
    other = lost.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = lambda a, b: a.eqNullSafe(b) if nulls else a == b
    return clean.unionByName(maybe.join(other, same(F.col(id_col), F.col(names["lost_id"])) & same(text, F.col(names["lost_text"])), "left_anti"))


def one_of_each(docs: DataFrame, repeated: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``docs`` with one row (any) of those that share an identifier and ``text`` named by ``repeated`` (lost_id, lost_text); null equals null.

    Rows that a filter of fixed size holds back stay where they are; copies are reduced in their tasks before they move.
    """
    names = {c: distinct_name(docs, c) for c in ("lost_id", "lost_text", "repeated_text")}
    repeated = staged(repeated, "repeated")
    if repeated.isEmpty():
        return docs
    maybe, clean = asked(docs, F.col(id_col), bit_filter(repeated, "lost_id"))
    other = repeated.select(*(F.col(c).alias(names[c]) for c in ("lost_id", "lost_text")))
    maybe = maybe.withColumn(names["repeated_text"], text)
    same = F.col(id_col).eqNullSafe(F.col(names["lost_id"])) & (F.col(names["repeated_text"]) == F.col(names["lost_text"]))
    single = maybe.join(other, same, "left_semi").dropDuplicates([id_col, names["repeated_text"]])
    return clean.unionByName(single.unionByName(maybe.join(other, same, "left_anti")).drop(names["repeated_text"]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string or binary column, without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = seeded(256, 11)
_PLACE = seeded(1 << 12, 12)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, and where each row's words begin (n + 1).

    A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
    """
    base = offs[0]
    d = _LOWER[raw[base : offs[-1]]]
    counts_at = np.zeros(len(offs), np.int64)
    if not len(d):
        return np.zeros(0, np.uint64), counts_at
    solid = ~_SPACE[d]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    rows = offs[:-1] - base
    rows = rows[rows < len(d)]
    begins[rows] = solid[rows]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), counts_at
    keep = np.flatnonzero(solid)
    first = np.searchsorted(keep, at)
    lens = np.diff(np.append(first, len(keep)))
    place = np.arange(len(keep)) - np.repeat(first, lens)
    far = place >> 12
    value = _BYTE[d[keep]] * _PLACE[place & 4095]
    if far.any():
        value = mix64(value + far.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    h = mix64(np.add.reduceat(value, first) + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(at, offs - base)


def batches_of(schema: pa.Schema, rows: Iterator[dict], limit: int = 16 << 20, size=lambda r: 64) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes from rows as dictionaries."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
