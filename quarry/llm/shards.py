"""Sharding by histogram sort: near-equal bytes, equal texts together, one exchange.

Rows are ordered by a key of three numbers: a digest of the text, a digest of the identifier, and
one that tells apart rows that share both. Nothing is sorted to find where shards end. Instead, every
task counts the exact bytes of its rows between candidate boundaries (probes) inside the stretches of
keys that hold a wanted boundary; the sums narrow each stretch to what lies between two probes, and
the next round refines it. A stretch of a single text gives its nearer edge if that is within
``tolerance`` of the wanted place, so that equal texts share a shard; a group of copies that is larger
is refined by identifier, down to one row, which goes to the side where more of it lies. Then
each row is moved once, to a file of its shard, and sorted there.

Probes and stretches are bounded (``PROBES``; one stretch for each boundary), whatever the number of
rows, and so is what a task returns. A large shard is several files, each a share of its rows by
a hash, so that a group of copies is spread over them. Slots (places in a shard, from 0) follow from the
rows of the files before.

Null text counts as no bytes, a null identifier as an empty one. Rows that share text and identifier are
told apart by their place in the input; where that isn't stable from one reading to the next, a boundary
among them is met on average only. An empty table gives no rows. Other columns pass through; new ones get underscores in front
where their names are taken (``shard_names``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import distinct_name, scratch, staged

#: Probes of one round, over all stretches together.
PROBES = 1 << 13
#: A boundary moves this share of a shard at most to keep equal texts together.
TOLERANCE = 0.005
#: Bytes that one task sorts and writes, and the most files of a shard.
FILE_BYTES, SHARD_FILES = 64 << 20, 4096

_KEY = ("k1", "k2", "k3")
#: Numbers of a key have 60 bits.
_TOP = 1 << 60


def _digest(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def _key_of(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    # Only rows of one text and identifier depend on the third number.
    return [_digest(text), _digest(name), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)]


def row_bytes(text_col: str) -> Column:
    """What a row counts: the bytes of its text, and one."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


@dataclass(frozen=True)
class Stretch:
    """Keys that begin with ``head`` and whose next number is ``low`` to ``high``; ``before`` bytes lie below, ``size`` inside."""

    head: tuple[int, ...]
    low: int
    high: int
    before: int
    size: int

    def probes(self, n: int) -> list[int]:
        """Where at most ``n`` bins begin, and the end of the last."""
        width = self.high - self.low + 1
        n = min(n, width)
        return [self.low + width * i // n for i in range(n + 1)]


def _histograms(keys: DataFrame, stretches: list[Stretch], probes: int) -> dict[Stretch, list[tuple]]:
    """For each stretch its filled bins in order: bytes, least and greatest key."""
    by_head: dict[tuple, list[Stretch]] = {}
    for s in sorted(stretches, key=lambda s: s.low):
        by_head.setdefault(s.head, []).append(s)
    # Stretches of one head don't overlap, so their probes are one ascending list; owner tells whose a bin is.
    edges, owner = {}, {}
    for head, own in by_head.items():
        lists = [s.probes(max(2, probes // len(stretches))) for s in own]
        edges[head] = np.array([p for one in lists for p in one], np.int64)
        owner[head] = [s if i < len(one) - 1 else None for s, one in zip(own, lists, strict=True) for i in range(len(one))]
    heads = list(by_head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(len(edges[h]), np.int64), np.full(len(edges[h]), _TOP), np.full(len(edges[h]), -1, np.int64)) for h in heads]
        for batch in batches:
            k, size = [batch.column(c).to_numpy() for c in _KEY], batch.column("size").to_numpy()
            for head, (total, least, most) in zip(heads, held, strict=True):
                mine = np.ones(len(size), bool)
                for number, c in zip(head, k, strict=False):
                    mine &= c == number
                value = k[len(head)][mine]
                b = np.searchsorted(edges[head], value, "right") - 1
                inside = b >= 0
                np.add.at(total, b[inside], size[mine][inside])
                np.minimum.at(least, b[inside], value[inside])
                np.maximum.at(most, b[inside], value[inside])
        for i, (total, least, most) in enumerate(held):
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(full), i), full, total[full], least[full], most[full])], ["head", "bin", "size", "least", "most"])

    counted = keys.mapInArrow(count, "head long, bin long, size long, least long, most long")
    out: dict[Stretch, list[tuple]] = {s: [] for s in stretches}
    # One row for each bin at most, however many tasks have counted.
    for r in sorted(counted.groupBy("head", "bin").agg(F.sum("size").alias("size"), F.min("least").alias("least"), F.max("most").alias("most")).collect()):
        if s := owner[heads[r.head]][r.bin]:
            out[s].append((r["size"], r.least, r.most))
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """The first key of each shard but the first, for keys (k1, k2, k3, size)."""
    root = keys.agg(F.sum("size").alias("size"), F.min("k1").alias("low"), F.max("k1").alias("high")).first()
    whole = root["size"]
    if not whole:
        return []
    now = dict.fromkeys(range(1, shards), Stretch((), root.low, root.high, 0, whole))
    done: dict[int, tuple[int, int, int]] = {}
    while now:
        wide = {s for s in now.values() if s.low < s.high}
        found = _histograms(keys, list(wide), probes) if wide else {}
        for i, s in list(now.items()):
            if s in found:
                before = s.before
                for size, least, most in found[s]:
                    if (before + size) * shards > i * whole:
                        now[i] = s = Stretch(s.head, least, most, before, size)
                        break
                    before += size
            if s.low < s.high:
                continue
            left, right = i * whole - s.before * shards, (s.before + s.size) * shards - i * whole
            if len(s.head) == 2 or not s.head and min(left, right) <= tolerance * whole:
                done[i] = (*s.head, s.low + (right < left), *[0] * (2 - len(s.head)))
                del now[i]
            else:
                now[i] = Stretch((*s.head, s.low), 0, _TOP - 1, s.before, s.size)
    return [done[i] for i in range(1, shards)]


def shard_names(docs: DataFrame) -> dict[str, str]:
    """The names of the columns that ``shard`` adds to those of ``docs``."""
    return {c: distinct_name(docs, c) for c in ("shard", "slot")}


def shard(docs: DataFrame, folder: str | None = None, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, probes: int = PROBES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``docs`` as ``shards`` shards to ``folder`` (a fresh one by default) and reads them back with shard and slot."""
    spark, names = docs.sparkSession, shard_names(docs)
    own = {c: distinct_name(docs, c) for c in (*_KEY, "shard_file", "shard_at")}
    key = _key_of(id_col, text_col)
    folder = folder or scratch(spark, "shards")
    keys = staged(docs.select(*(c.alias(n) for n, c in zip(_KEY, key, strict=True)), row_bytes(text_col).alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    files = min(SHARD_FILES, max(1, -(-total // (shards * file_bytes))))
    placed = docs.select("*", *(c.alias(own[n]) for n, c in zip(_KEY, key, strict=True)))
    mine = F.struct(*(F.col(own[c]) for c in _KEY))
    passed = [(mine >= F.struct(*(F.lit(x).cast("long") for x in cut))).cast("int") for cut in splitters(keys, shards, tolerance, probes)]
    placed = placed.withColumn(names["shard"], sum(passed, F.lit(0)))
    placed = placed.withColumn(own["shard_file"], F.pmod(F.xxhash64(own["k2"], own["k3"]), F.lit(files)).cast("int"))
    moved = placed.repartitionById(shards * files, F.col(names["shard"]) * files + F.col(own["shard_file"]))
    ordered = moved.sortWithinPartitions(names["shard"], own["shard_file"], *(own[c] for c in _KEY)).drop(*(own[c] for c in _KEY))
    # A task's low 33 bits count its rows.
    numbered = ordered.withColumn(own["shard_at"], F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.write.option("compression", "zstd").partitionBy(names["shard"], own["shard_file"]).parquet(folder)
    written = spark.read.schema(numbered.schema).parquet(folder)
    # A row for each file: SHARD_FILES of a shard at most.
    earlier = Window.partitionBy(names["shard"]).orderBy(own["shard_file"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy(names["shard"], own["shard_file"]).agg(F.count(F.lit(1)).alias("n")).select(names["shard"], own["shard_file"], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(names["slot"]))
    out = written.join(F.broadcast(starts), [names["shard"], own["shard_file"]])
    return out.select(*docs.columns, names["shard"], (F.col(names["slot"]) + F.col(own["shard_at"])).alias(names["slot"]))
