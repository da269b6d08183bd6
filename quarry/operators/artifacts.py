"""SNK16: a content-addressed artifact of shards, with manifests that are activated, rolled back and collected.

A row belongs to the shard that a digest of its key names. A shard's content is named by a digest that adds
up over its rows, so it doesn't hang on their order or files. A build writes only the contents that no
earlier build has written; its manifest lists the contents of all shards and names the manifest it follows.
What is active is told by the last entry of a log, each entry a folder of its own that no one may
overwrite. A content that no kept manifest lists is garbage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graphs import cut

#: Files into which the rows of one shard are dealt when they are written.
FILES = 4
_WRAP = 1 << 40


class Artifact:
    """Under ``folder``: contents/content=*, manifests/manifest=*, log/entry=*."""

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: Sequence[str], shards: int = 64):
        self.spark, self.folder, self.key, self.columns, self.shards = spark, folder, key, list(columns), shards

    def _paths(self, kind: str) -> list[str]:
        """Names of the folders of one kind: as many as shards and builds, not rows."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName().split("=", 1)[1] for s in system.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()) if system.exists(path) else []

    def shard_of(self) -> Column:
        return F.pmod(F.conv(F.substring(F.sha2(F.col(self.key).cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(self.shards)).cast("int")

    def _contents(self, rows: DataFrame) -> DataFrame:
        """(shard, rows, content): what each shard holds, by sums of four pieces of the rows' SHA-256 digests."""
        whole = F.sha2(F.to_json(F.struct(self.key, *self.columns), {"ignoreNullFields": "false"}), 256)
        pieces = [F.conv(F.substring(whole, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(8)]
        sums = [(F.sum(p) % _WRAP).cast("string").alias(f"p{k}") for k, p in enumerate(pieces)]
        found = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *sums)
        return found.select("shard", "rows", F.sha2(F.concat_ws(":", F.col("shard").cast("string"), F.col("rows").cast("string"), *(f"p{k}" for k in range(8))), 256).alias("content"))

    def build(self, rows: DataFrame) -> tuple[str, int]:
        """Writes what is new, and a manifest that follows the active one; gives its name and the number of contents written. It isn't active yet."""
        placed = rows.select(self.key, *self.columns, self.shard_of().alias("shard"))
        listed = sorted(self._contents(placed).collect())  # one row for each shard
        name = hashlib.sha256("\n".join(f"{r.shard}:{r.content}" for r in listed).encode()).hexdigest()
        # Manifests are written after the contents they list, so what one lists is complete.
        known = {r.content for r in self.spark.read.parquet(f"{self.folder}/manifests").select("content").distinct().collect()} if self._paths("manifests") else set()
        new = [(r.shard, r.content) for r in listed if r.content not in known]
        if new:
            wanted = self.spark.createDataFrame(new, "shard int, content string")
            fresh = placed.join(F.broadcast(wanted), "shard")  # at most one row for each shard
            dealt = fresh.repartition("shard", F.pmod(F.xxhash64(self.key), F.lit(FILES)))
            # A content that a lost build has half written is overwritten.
            dealt.drop("shard").sortWithinPartitions("content", self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content").parquet(f"{self.folder}/contents")
        if name not in self._paths("manifests"):
            rows_ = [(r.shard, r["rows"], r.content, self.active()) for r in listed]
            self.spark.createDataFrame(rows_, "shard int, rows long, content string, follows string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/manifest={name}")
        return name, len(new)

    def manifest(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifests/manifest={name}")

    def active(self) -> str | None:
        entries = self._paths("log")
        return self.spark.read.parquet(f"{self.folder}/log/entry={entries[-1]}").first()[0] if entries else None

    def activate(self, name: str, expected: str | None = None) -> None:
        """Makes a manifest the active one, if ``expected`` (where given) still is; the loser of two at once gets an error."""
        if name not in self._paths("manifests"):
            raise ValueError(f"no manifest {name}")
        if expected is not None and self.active() != expected:
            raise RuntimeError("another manifest has been activated meanwhile")
        number = len(self._paths("log"))
        self.spark.createDataFrame([(name,)], "manifest string").write.mode("errorifexists").parquet(f"{self.folder}/log/entry={number:012d}")

    def rollback(self) -> str:
        """Activates the manifest that the active one follows."""
        before = self.manifest(self.active()).first().follows
        if before is None:
            raise RuntimeError("nothing came before")
        self.activate(before)
        return before

    def rows(self, name: str | None = None) -> DataFrame:
        """The rows of a manifest, the active one by default."""
        contents = [r.content for r in self.manifest(name or self.active()).select("content").collect()]  # one for each shard
        read = self.spark.read.option("basePath", f"{self.folder}/contents").parquet(*(f"{self.folder}/contents/content={c}" for c in contents))
        return read.drop("content")

    def digest(self, name: str | None = None) -> str:
        """The name that what is stored gives, for a check of the files themselves."""
        listed = sorted(self._contents(cut(self.rows(name).withColumn("shard", self.shard_of()))).collect())
        return hashlib.sha256("\n".join(f"{r.shard}:{r.content}" for r in listed).encode()).hexdigest()

    def collect_garbage(self, keep: int = 2) -> list[str]:
        """Removes the contents and manifests that neither the active manifest nor the ``keep`` - 1 before it need; gives the contents."""
        kept, name = [], self.active()
        while name and len(kept) < keep:
            kept.append(name)
            name = self.manifest(name).first().follows
        needed = {r.content for m in kept for r in self.manifest(m).select("content").collect()}
        dead = [c for c in self._paths("contents") if c not in needed]
        for kind, names in (("contents/content", dead), ("manifests/manifest", [m for m in self._paths("manifests") if m not in kept])):
            for one in names:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}={one}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return dead
