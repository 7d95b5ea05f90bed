"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of few files dealt to all cores, for work that is heavy by row; a scan with a task for every core stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of an Arrow batch where whole texts are worked on.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_ROWS rows: a batch of whole texts is held several times over, by the JVM and by its Python worker. A session that asks for fewer keeps its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
