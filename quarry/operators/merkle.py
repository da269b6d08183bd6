"""Anti-entropy: trees of mergeable digests over snapshots, searched only where two snapshots differ.

A snapshot's rows lie by a hash of their key; the hash's leading bits name a leaf, fewer of them an inner
node. A node holds the number of its rows and sums of their digests, so nodes merge by adding up and any
order of rows gives the same tree. Two snapshots are compared from the root down, a level at a time, and
only below nodes that differ; then the rows of the differing leaves are read, and no others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graphs import cut

#: Bits that a level adds to a node's name, and the number of levels below the root: 65,536 leaves.
BITS, DEPTH = 4, 4
#: Levels whose nodes have folders of their own, so that a search leaves out what it doesn't need; one is enough for small tables.
FOLDERS = 2
#: Sums are kept modulo a power of two, which lets nodes of any number of rows be added up.
_WRAP = 1 << 40


def _leaf(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS * DEPTH)


def node_sums(rows: DataFrame, by: str | Column, digest: Column | None = None) -> DataFrame:
    """(node, n, low, high, mixed): of the rows of each node, the number, two sums and the exclusive or of their 64-bit digests."""
    rows = rows.select((F.col(by) if isinstance(by, str) else by).alias("node"), digest.alias("_d"))
    low, high = F.col("_d").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_d", 32)
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), (F.sum(low) % _WRAP).alias("low"), (F.sum(high) % _WRAP).alias("high"), F.bit_xor("_d").alias("mixed"))


def merged(nodes: DataFrame) -> DataFrame:
    """The level above: nodes added up by all but the last bits of their names."""
    up = nodes.groupBy(F.shiftright("node", BITS).alias("node"))
    return up.agg(F.sum("n").alias("n"), (F.sum("low") % _WRAP).alias("low"), (F.sum("high") % _WRAP).alias("high"), F.bit_xor("mixed").alias("mixed"))


class Snapshot:
    """A table laid out by leaf under a folder, with its tree."""

    def __init__(self, spark: SparkSession, folder: str, key: str, folders: int = FOLDERS):
        self.spark, self.folder, self.key, self.shift = spark, folder, key, BITS * (DEPTH - folders)

    @classmethod
    def write(cls, rows: DataFrame, folder: str, key: str, columns: Sequence[str], folders: int = FOLDERS) -> Snapshot:
        """Keeps ``key`` and ``columns`` of ``rows``; the digest of a row is over all of them. Rows of one key count each."""
        made = cls(rows.sparkSession, folder, key, folders)
        laid = rows.select(key, *columns).withColumn("leaf", _leaf(key)).withColumn("stem", F.shiftright("leaf", made.shift))
        laid.repartitionByRange("leaf").sortWithinPartitions("stem", "leaf").write.partitionBy("stem").parquet(f"{folder}/rows")
        stored = made.rows()
        names = [F.lit(0).cast("long"), F.col(key), *(F.struct(F.col(c).isNull(), F.col(c)) for c in columns)]
        level = cut(node_sums(stored, "leaf", F.xxhash64(*names)))
        levels = [level.withColumn("level", F.lit(DEPTH))]
        for depth in range(DEPTH - 1, -1, -1):
            level = merged(level)
            levels.append(level.withColumn("level", F.lit(depth)))
        reduce(DataFrame.unionByName, levels).withColumn("above", F.shiftright("node", BITS)).coalesce(1).write.partitionBy("level").parquet(f"{folder}/nodes")  # a tree has a fixed size
        return made

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes").filter(F.col("level") == level)

    def rows_of(self, leaves: Sequence[int]) -> DataFrame:
        """The rows of some leaves: folders and then row groups without them are passed over."""
        stems = sorted({leaf >> self.shift for leaf in leaves})
        return self.rows().filter(F.col("stem").isin(stems) & F.col("leaf").isin(list(leaves))).drop("stem", "leaf")


def differing_leaves(a: Snapshot, b: Snapshot) -> tuple[list[int], int]:
    """Leaves whose sums differ, and how many pairs of nodes were compared; at most all nodes of a tree reach the driver."""
    open_, compared = [0], 0
    fields = ("n", "low", "high", "mixed")
    for level in range(DEPTH + 1):
        sides = [s.nodes(level).filter(F.col("above" if level else "node").isin(open_)).select("node", F.struct(*fields).alias(side)) for s, side in ((a, "a"), (b, "b"))]
        met = sides[0].join(sides[1], "node", "full_outer").select("node", F.col("a").eqNullSafe(F.col("b")).alias("same")).collect()
        compared += len(met)
        open_ = sorted(r.node for r in met if not r.same)
        if not open_:
            return [], compared
    return open_, compared


def differences(source: Snapshot, target: Snapshot, columns: Sequence[str]) -> DataFrame:
    """(key, side): keys that one snapshot lacks or that have other values there; keys are unique in each snapshot."""
    key = source.key
    leaves, _ = differing_leaves(source, target)
    s, t = source.rows_of(leaves).alias("s"), target.rows_of(leaves).alias("t")
    other = reduce(lambda x, y: x | y, (~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in columns), F.lit(False))
    side = F.when(F.col(f"t.{key}").isNull(), "missing_in_target").when(F.col(f"s.{key}").isNull(), "missing_in_source").when(other, "changed")
    both = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")
    return both.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), side.alias("side")).filter("side IS NOT NULL")


def repaired(source: Snapshot, target: Snapshot, columns: Sequence[str], folder: str) -> tuple[Snapshot, DataFrame]:
    """A snapshot of the target with all differences mended, and (key, side) of what a second comparison still finds.

    Rows of the source replace or join the target's; rows that the source lacks go.
    """
    found = cut(differences(source, target, columns))
    key = source.key
    kept = target.rows().select(key, *columns).join(found.select(key), key, "left_anti")
    leaves, _ = differing_leaves(source, target)
    added = source.rows_of(leaves).select(key, *columns).join(found.filter("side <> 'missing_in_source'").select(key), key, "left_semi")
    mended = Snapshot.write(kept.unionByName(added), folder, key, columns, DEPTH - source.shift // BITS)
    return mended, differences(source, mended, columns)
