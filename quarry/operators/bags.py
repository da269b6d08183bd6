"""Bags of meanings that are stored, checked against their source, and the state of their index.

A unit's sources are its title and its sentences, by offsets. They are dealt in order to bags of fixed size,
so a unit of any length has bags enough and no bag outgrows a task. A bag's members are clustered by their
vectors; a group is named by a digest of its members, a bag by digests of its sources and of all it holds.

``verify`` derives the sources from the live units again and tells for each bag what, if anything, no
longer holds. ``states`` combines those verdicts with the log of runs and the prints of the live input:
an index is ready if its last run is complete, has read what is there now, and every bag is valid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import retrieval as V
from quarry.operators import spans as P
from quarry.operators.merkle import node_sums

#: What a bag may be found to be, the gravest last.
VERDICTS = ("VALID", "CHECKSUM", "GROUPS", "VECTORS", "MEMBERS", "SOURCE_CHANGED", "SETTINGS", "ORPHAN", "MISSING")


@dataclass(frozen=True)
class Settings:
    """What a bag is made with; bags of other settings don't count."""

    version: str = "1"
    model: str = "hashed-terms"
    dimension: int = 64
    threshold: float = 0.5
    size: int = 64

    def name(self) -> str:
        return f"{self.version}|{self.model}|{self.dimension}|{self.threshold}|{self.size}"


def hashed_vector(tokens: Column, dimension: int) -> Column:
    """Counts of tokens by their hash: a vector for texts where no model gives one."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int"))
    return X.let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double")))


def _bagged(units: DataFrame, root: str, unit: str, text: str, size: int, title: str | None = None) -> DataFrame:
    """(bag, root, unit, m): a row for each bag with its members (place, kind, start, stop, text, digest) in order, made where the unit lies."""
    # Named by place, so columns of the caller's that are called alike do no harm.
    rows = units.select(F.col(root).alias("root"), F.col(unit).alias("unit"), F.col(text).alias("body"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"))
    entry = lambda kind, start, stop: F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"))
    named = F.when(F.trim("title") != "", F.array(entry("title", F.lit(0), F.char_length("title")))).otherwise(F.expr("CAST(array() AS array<struct<kind:string,start:int,stop:int>>)"))
    found = F.concat(named, F.transform(P.sentence_spans(F.col("body")), lambda s: entry("text", s["start"], s["end"])))
    parts = X.let(found, lambda f: F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / size).cast("int")), lambda k: F.when(F.size(f) > 0, F.slice(f, k * size + 1, F.lit(size)))))
    each = rows.select("root", "unit", "body", "title", F.posexplode(parts).alias("part", "s")).filter("s IS NOT NULL")
    bag = F.to_json(F.struct("root", "unit", "part"), {"ignoreNullFields": "false"})

    def member(s: Column, i: Column) -> Column:
        whole = F.when(s["kind"] == "title", F.col("title")).otherwise(F.col("body"))
        return F.struct((F.col("part") * size + i).alias("place"), s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.substring(whole, s["start"] + 1, s["stop"] - s["start"]).alias("text"))

    made = each.select(bag.alias("bag"), "root", "unit", F.transform("s", member).alias("m"))
    return made.withColumn("m", F.transform("m", lambda x: F.struct(*(x[c].alias(c) for c in _MEMBER), _digest(*(x[c].alias(c) for c in _MEMBER)).alias("digest"))))


_MEMBER = ("place", "kind", "start", "stop", "text")


def _digest(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def sources(units: DataFrame, root: str, unit: str, text: str, size: int, title: str | None = None) -> DataFrame:
    """(bag, root, unit, place, kind, start, stop, text): the title, if it isn't blank, then the sentences; without a shuffle.

    A unit without words has none. Bags are named by root, unit and the sources' places, nulls included.
    """
    return _bagged(units, root, unit, text, size, title).select("bag", "root", "unit", F.explode("m").alias("s")).select("bag", "root", "unit", *(f"s.{c}" for c in _MEMBER))


def _joined(rows: Column, value: str) -> Column:
    """A digest of a value over the members of a bag or group, in their order."""
    return F.sha2(F.array_join(F.transform(rows, lambda x: x[value]), ","), 256)


def _group_names(rows: Column) -> Column:
    """The names of the members' groups: a digest of all that are in the same cluster."""
    return F.transform(rows, lambda x: F.substring(_joined(F.filter(rows, lambda y: y["cluster"] == x["cluster"]), "digest"), 1, 24))


def _grouped(bags: DataFrame, settings: Settings) -> DataFrame:
    """Bags with the vectors and clusters of their members; a bag is one row, so none of it is shuffled."""
    dimension, threshold = settings.dimension, settings.threshold
    places = F.transform("m", lambda x: F.transform(X.surface_tokens(x["text"]), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int")))
    asked = bags.select("bag", "root", "unit", "m", places.alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                sizes = part.column(4).value_lengths().to_numpy()
                tokens = part.column(4).flatten()
                row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy())
                m = np.bincount(row * dimension + tokens.flatten().to_numpy(), minlength=len(tokens) * dimension).reshape(-1, dimension).astype(float)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                found = np.concatenate([V.linked(m[a:b], threshold) for a, b in zip(ends[:-1], ends[1:])])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dimension), pa.array(m.ravel()))
                listed = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (vectors, pa.array(found, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), *listed], names=["bag", "root", "unit", "m", "vectors", "clusters"])

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in ("bag", "root", "unit", "m"))
    made = asked.mapInArrow(run, f"{kinds}, vectors array<array<double>>, clusters array<int>")
    rows = F.transform("m", lambda x, i: F.struct(*(x[c].alias(c) for c in (*_MEMBER, "digest")), F.get("vectors", i).alias("vector"), F.get("clusters", i).alias("cluster")))
    made = made.select("bag", "root", "unit", rows.alias("m"))
    return made.select("bag", "root", "unit", "m", _group_names(F.col("m")).alias("names"))


def _told(members: DataFrame, settings: Settings) -> DataFrame:
    """(bag, build, source_print, print, bad_vectors, bad_groups) of stored members; digests alone are shuffled, not texts or vectors."""
    digest = _digest(*(F.col(c) for c in _MEMBER))
    rows = members.withColumn("digest", digest)
    own = F.sha2(F.concat_ws("|", "digest", F.col("cluster").cast("string"), "group_id", F.to_json("vector")), 256)
    bad = F.col("vector").isNull() | (F.size("vector") != settings.dimension) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    listed = F.array_sort(F.collect_list(F.struct("place", F.unhex("digest").alias("digest"), "cluster", "group_id", F.unhex(own).alias("own"))))  # half as long as in letters
    made = rows.groupBy("bag", "build").agg(listed.alias("m"), F.bool_or(bad).alias("bad_vectors"))
    letters = lambda x, c: F.lower(F.hex(x[c])).alias(c)
    made = made.withColumn("m", F.transform("m", lambda x: F.struct(letters(x, "digest"), x["cluster"].alias("cluster"), x["group_id"].alias("group_id"), letters(x, "own"))))
    wrong = F.exists(F.zip_with("m", _group_names(F.col("m")), lambda x, name: ~x["group_id"].eqNullSafe(name)), lambda x: x)
    return made.select("bag", "build", _joined(F.col("m"), "digest").alias("source_print"), _joined(F.col("m"), "own").alias("print"), "bad_vectors", wrong.alias("bad_groups"))


class BagStore:
    """Under ``folder``: members and bags, a folder for each build; a later build's bags stand for the units that it names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, number: int, units: DataFrame, root: str, unit: str, text: str, settings: Settings, title: str | None = None) -> None:
        """Bags of ``units``, whose identifiers are unique within their root; a build that is run again overwrites itself."""
        found = _grouped(_bagged(units, root, unit, text, settings.size, title), settings)
        members = found.select("bag", "root", "unit", F.explode(F.arrays_zip("m", "names")).alias("x"))
        members = members.select("bag", "root", "unit", *(f"x.m.{c}" for c in (*_MEMBER, "vector", "cluster")), F.col("x.names").alias("group_id"))
        members.write.mode("overwrite").parquet(f"{self.folder}/members/build={number}")
        stored = self.spark.read.parquet(f"{self.folder}/members/build={number}").withColumn("build", F.lit(number))
        named = stored.groupBy("bag").agg(F.first("root").alias("root"), F.first("unit").alias("unit"))
        bags = _told(stored, settings).join(named, "bag").withColumn("settings", F.lit(settings.name()))
        # Bags are written after their members, so what is listed is there.
        bags.select("bag", "root", "unit", "settings", "source_print", "print").write.mode("overwrite").parquet(f"{self.folder}/bags/build={number}")

    def _newest(self, kind: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{kind}")
        last = self.spark.read.parquet(f"{self.folder}/bags").groupBy("root", "unit").agg(F.max("build").alias("last"))
        same = rows["root"].eqNullSafe(last["root"]) & rows["unit"].eqNullSafe(last["unit"]) & (rows["build"] == last["last"])
        return rows.join(last, same, "left_semi")

    def bags(self) -> DataFrame:
        return self._newest("bags")

    def members(self) -> DataFrame:
        return self._newest("members")

    def verify(self, units: DataFrame, root: str, unit: str, text: str, settings: Settings, title: str | None = None) -> DataFrame:
        """(bag, root, unit, verdict) of all stored bags and all bags that the live units should have.

        VALID, or the gravest fault: MISSING, ORPHAN (no such source now), SETTINGS, SOURCE_CHANGED, MEMBERS (they aren't the
        stored sources), VECTORS (length, or components that aren't numbers), GROUPS (not named by their members), CHECKSUM.
        """
        live = _bagged(units, root, unit, text, settings.size, title)
        # A unit that is there more than once has its members listed together.
        live = live.groupBy("bag").agg(F.first("root").alias("live_root"), F.first("unit").alias("live_unit"), F.array_sort(F.flatten(F.collect_list(F.transform("m", lambda x: F.struct(x["place"].alias("place"), x["digest"].alias("digest")))))).alias("m"))
        live = live.select("bag", "live_root", "live_unit", _joined(F.col("m"), "digest").alias("live_print"))
        told = _told(self.spark.read.parquet(f"{self.folder}/members"), settings).withColumnsRenamed({"source_print": "member_print", "print": "own_print"})
        both = self.bags().join(told, ["bag", "build"], "left").join(live, "bag", "full_outer")
        verdict = (
            F.when(F.col("settings").isNull(), "MISSING").when(F.col("live_print").isNull(), "ORPHAN").when(F.col("settings") != settings.name(), "SETTINGS")
            .when(F.col("source_print") != F.col("live_print"), "SOURCE_CHANGED").when(~F.col("member_print").eqNullSafe(F.col("source_print")), "MEMBERS")
            .when(F.col("bad_vectors"), "VECTORS").when(F.col("bad_groups"), "GROUPS").when(F.col("own_print") != F.col("print"), "CHECKSUM").otherwise("VALID")
        )
        here = F.col("live_print").isNotNull()
        return both.select("bag", F.when(here, F.col("live_root")).otherwise(F.col("root")).alias("root"), F.when(here, F.col("live_unit")).otherwise(F.col("unit")).alias("unit"), verdict.alias("verdict"))


def gravest(verdicts: DataFrame, *by: str) -> DataFrame:
    """The gravest verdict on the bags of each unit or root."""
    place = F.array_position(F.array(*(F.lit(v) for v in VERDICTS)), F.col("verdict"))
    return verdicts.groupBy(*by).agg(F.max_by("verdict", place).alias("verdict"))


def input_prints(units: DataFrame, root: str, unit: str, text: str, columns: Sequence[str], settings: Settings) -> DataFrame:
    """(root, print, blank, repeated): a print of all that an index is made from, settings included; sums, whatever the order.

    ``repeated`` counts the units that share an identifier with another of their root.
    """
    values = [F.struct(F.col(c).isNull(), F.col(c)) for c in (unit, text, *columns)]
    rows = units.select(F.struct(F.col(root).alias("root")).alias("node"), F.xxhash64(F.lit(settings.name()), *values).alias("d"), F.col(unit).alias("unit"), (~F.coalesce(F.col(text), F.lit("")).rlike(r"\S")).alias("blank"))
    sums = node_sums(rows, "node", F.col("d"))
    once = rows.groupBy("node", "unit").agg(F.count(F.lit(1)).alias("n"), F.bool_and("blank").alias("blank"))
    checks = once.groupBy("node").agg(F.bool_and("blank").alias("blank"), F.sum(F.col("n") - 1).alias("repeated"))
    print_ = F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "low", "high", "mixed")))
    return sums.select("node", print_.alias("print")).join(checks, "node").select("node.root", "print", "blank", "repeated")


def states(prints: DataFrame, runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(root, state, code): of each root with units or runs; a state and why it isn't READY.

    ``runs`` (root, run, status, print, error) are all runs so far, the greatest ``run`` is the last; ``verdicts`` come from ``BagStore.verify``.
    """
    last = runs.groupBy("root").agg(F.max_by(F.struct("status", "print", "error"), "run").alias("last"))
    invalid = verdicts.groupBy("root").agg(F.bool_or(F.col("verdict") != "VALID").alias("invalid"))
    live, done = prints.alias("p"), last.alias("l")
    both = live.join(done, F.col("p.root").eqNullSafe(F.col("l.root")), "full_outer")
    both = both.select(F.coalesce("p.root", "l.root").alias("root"), "print", "blank", "repeated", "last").alias("b")
    both = both.join(invalid.alias("i"), F.col("b.root").eqNullSafe(F.col("i.root")), "left").select("b.*", F.coalesce("invalid", F.lit(False)).alias("invalid"))
    cases = [
        (F.col("print").isNull() | (F.col("repeated") > 0), "CONTENT_NOT_READY", F.lit("CONTENT_NOT_READY")),
        (F.col("blank"), "CONTENT_NOT_READY", F.lit("EMPTY_CONTENT")),
        (F.col("last").isNull(), "NOT_STARTED", F.lit(None).cast("string")),
        (~F.col("last.print").eqNullSafe(F.col("print")), "STALE", F.lit("INDEX_SOURCE_CHANGED")),
        ((F.col("last.status") == "COMPLETED") & F.col("invalid"), "STALE", F.lit("INDEX_ARTIFACT_INVALID")),
        (F.col("last.status") == "COMPLETED", "READY", F.lit(None).cast("string")),
    ]
    state, code = F.col("last.status"), F.when(F.col("last.status") == "FAILED", F.col("last.error"))
    for when, name, why in reversed(cases):
        state, code = F.when(when, name).otherwise(state), F.when(when, why).otherwise(code)
    return both.select("root", state.alias("state"), code.alias("code"))
