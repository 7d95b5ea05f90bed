"""A table of results by key that outlives a run: only keys that it doesn't hold yet are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Memo:
    """Parquet at `path`, in folders by a hash of the key, so that a lookup reads only the folders that its new keys fall into.

    schema: the columns that `compute` adds to a key. Runs that share a path must not overlap:
    two of them could both compute, and then both keep, the same key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path, f"key string, {schema}, bucket int", buckets

    def stored(self) -> DataFrame:
        """All results so far; none before the first run."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def missing(self, keys: DataFrame) -> DataFrame:
        """Each key (column key) that has no result, once; null keys have none and get none."""
        wanted = keys.select("key").where("key IS NOT NULL").distinct().withColumn("bucket", self.bucket())
        return wanted.join(self.stored().select("bucket", "key"), ["bucket", "key"], "left_anti")

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def completed(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> None:
        """Computes and appends what is missing. compute: from rows (key) to rows of key and the schema's columns. A run that fails before its write ends has stored nothing."""
        fresh = compute(self.missing(keys).select("key"))
        fresh.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def looked_up(self, rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with the result of their key, computed once for each key however many rows and runs ask for it; null for a null key."""
        self.completed(rows.select(F.col(key).alias("key")), compute)
        found = self.stored().drop("bucket")
        return rows.join(found.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left").drop("__key")
