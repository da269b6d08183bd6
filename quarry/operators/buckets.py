"""Tables kept in buckets of keys, of which a step rewrites those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class Buckets:
    """Step n makes version n of the buckets that it touches from the versions below n, so one that is run again overwrites its own alone."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, T._parse_datatype_string(schema), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, buckets: bool = False) -> DataFrame:
        """The rows as of the last step (or the last below ``before``): of each bucket its newest version."""
        full = T.StructType([*self.schema.fields, T.StructField("step", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        if not exists(self.spark, self.folder):
            rows = self.spark.createDataFrame([], full)
        else:
            rows = self.spark.read.schema(full).parquet(self.folder)
            rows = rows if before is None else rows.filter(F.col("step") < before)
            newest = rows.groupBy("bucket").agg(F.max("step").alias("step"))  # a row for each bucket
            rows = rows.join(F.broadcast(newest), ["bucket", "step"])
        return rows.select(*self.schema.names, *["bucket"] * buckets)

    def write(self, number: int, changed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Version ``number`` of the buckets of ``changed``: what ``merge`` makes of their stored and changed rows. Without changes nothing is written."""
        changed = changed.select(*self.schema.names).withColumn("bucket", self.bucket())
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most all buckets
        if touched:
            stored = self.read(number, True).filter(F.col("bucket").isin(touched))
            merge(stored, changed).select(*self.schema.names, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/step={number}")

    def replace(self, number: int, changed: DataFrame) -> None:
        """Puts the rows of ``changed`` in the place of stored rows with their keys."""
        self.write(number, changed, lambda stored, new: stored.join(new.select(self.key), self.key, "left_anti").select(*new.columns).unionByName(new))
