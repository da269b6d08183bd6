"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Memtables are the batches of rows whose keys hash to one run. Each flushes as a level-0 run: one
Parquet file sorted by digest, with a Bloom filter and min/max statistics on the digest. Compaction
merges ``FANOUT`` runs at a time into a run of the next level, which is a series of files in digest
order, until one run is left; of each digest it keeps the smallest identifier and the number of
rows. Digests with more than one row are hits. A filter of fixed size, made of the hits' identifiers,
is asked for every row, and only texts that it lets through are digested again and moved. They are compared byte by
byte with the text that stays; where they differ (a digest collision) the rows of that digest are
grouped by their text instead.

Null text is empty text. Equal texts with equal identifiers count as repeated rows: they form one
group, ``group_size`` counts each, and each row is returned; of rows repeated with the identifier
that stays, every one is marked kept in the listing, since nothing tells them apart; ``drop_exact`` lets one of
them stay. A null identifier loses to any other. Other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, asked, bit_filter, one_of_each, scratch, staged, without_lost

#: Rows that one memtable holds before it flushes.
MEMTABLE_ROWS = 1 << 17
#: Runs of a level that are merged into one of the next.
FANOUT = 16


class DigestIndex:
    """Sorted digest runs under one folder; ``keep`` says which identifier counts as smallest."""

    def __init__(self, spark: SparkSession, folder: str, keep: str = "max"):
        self.spark, self.folder, self.top = spark, folder, 0
        self.best = F.max if keep == "max" else F.min

    def _write(self, df: DataFrame, level: int) -> None:
        (
            df.write.partitionBy("run")
            .option("compression", "zstd")
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", str(MEMTABLE_ROWS))
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(f"{self.folder}/level{level}")
        )

    def level(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/level{level}")

    def flush(self, rows: DataFrame, runs: int) -> None:
        """Level 0: ``rows`` (digest, id, run) as ``runs`` runs. A run is one task's work, hence one file in order."""
        merged = rows.groupBy("run", "digest").agg(self.best("id").alias("id"), F.count(F.lit(1)).alias("n")).select("digest", "id", "n", "run")
        self.schema, self.top, self.runs = merged.schema, 0, runs
        self._write(merged.repartition("run").sortWithinPartitions("run", "digest"), 0)

    def compact(self) -> DataFrame:
        """Merges level by level until one run is left: every digest once, with the identifier that stays and the number of rows."""
        while self.runs > 1:
            grouped = self.level(self.top).withColumn("run", F.expr(f"CAST(run DIV {FANOUT} AS int)")).repartitionByRange("run", "digest")
            merged = grouped.groupBy("run", "digest").agg(self.best("id").alias("id"), F.sum("n").alias("n"))
            self._write(merged.sortWithinPartitions("run", "digest").select("digest", "id", "n", "run"), self.top + 1)
            self.top, self.runs = self.top + 1, -(-self.runs // FANOUT)
        return self.level(self.top).drop("run")

    def lookup(self, digests: list) -> DataFrame:
        """Entries of a few digests; Parquet's filters and statistics skip files and row groups without them."""
        return self.level(self.top).filter(F.col("digest").isin(digests)).drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=None, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``digest`` maps the normalised text column to the index key; the default is SHA-256.
    """
    spark = docs.sparkSession
    digest = digest or (lambda text: F.unhex(F.sha2(text, 256)))
    text = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("norm"))
    rows = staged(whole.select("id", digest(F.col("norm")).alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-rows")
    runs = max(1, -(-rows.count() // memtable_rows))
    index = DigestIndex(spark, scratch(spark, "exact-index"), keep)
    index.flush(rows.select("id", "digest", F.pmod(F.xxhash64("id", "digest"), F.lit(runs)).cast("int").alias("run")), runs)
    hits = staged(index.compact().filter("n > 1").withColumnsRenamed({"id": "keep_id", "n": "group_size"}), "exact-repeated")
    found = staged(rows.join(hits, "digest", "left"), "exact-found")
    maybe, _ = asked(whole, F.col("id"), bit_filter(found.filter("group_size > 1"), "id"))
    texts = staged(maybe.withColumn("digest", digest(F.col("norm"))).join(hits, "digest"), "exact-hits")
    keeper = staged(texts.filter(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"]).select("digest", F.col("norm").alias("kept_norm")), "exact-keepers")
    # Written as it is, so that a large group's rows may be compared in several tasks.
    collided = staged(texts.join(keeper, "digest").filter(F.col("norm") != F.col("kept_norm")).select("digest"), "exact-collided")
    size = F.coalesce("group_size", F.lit(1))
    keep_id = F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("id"))
    out = found
    if not collided.isEmpty():
        collided = collided.distinct()
        split = texts.join(collided, "digest", "left_semi").groupBy("digest", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm").agg(index.best("id").alias("true_id"), F.count(F.lit(1)).alias("true_n")).drop("norm")
        out = out.join(staged(split, "exact-split"), ["digest", "sha"], "left")
        keep_id = F.when(F.col("true_n").isNotNull(), F.col("true_id")).otherwise(keep_id)
        size = F.coalesce("true_n", size)
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), size.cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each text, with all their columns.

    Of rows repeated with the identifier that stays, a null one too, any one stays.
    """
    groups = staged(exact_groups(docs, id_col, text_col, keep).filter("group_size > 1").select(F.col(id_col).alias("lost_id"), F.col("text_sha256").alias("lost_text"), "kept"), "exact-decided")
    text = F.sha2(F.coalesce(ascii_lower(F.col(text_col)), F.lit("")), 256)
    # Rows of one identifier, a null one too, may hold different texts, so the text's digest is part of the key.
    left = without_lost(docs, groups.filter("NOT kept").drop("kept"), id_col, text, nulls=True)
    repeated = groups.filter("kept").groupBy("lost_id", "lost_text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return one_of_each(left, repeated, id_col, text)
