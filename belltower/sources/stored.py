"""Tables that are written once and read back, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKED: set[str] = set()
_MADE: dict[tuple[str, str], object] = {}
T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may do without the setting: it gets a folder of its own machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/belltower-checkpoints"
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's own folder in the shared one; it goes when the session's JVM ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/belltower-{context.applicationId}"
    if folder not in _MARKED:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MARKED.add(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, what reads it doesn't compute it again, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def signature(source: DataFrame) -> str:
    """Tells the files that a scan reads: a hash of their paths, sizes and times of change."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, h = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return f"{n}-{h}"


def made_once(spark: SparkSession, key: str, make: Callable[[], T]) -> T:
    """What make gives, made once in a Spark application for a key; for things that hold stored tables and little else."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _MADE:
        _MADE[at] = make()
    return _MADE[at]  # type: ignore[return-value]
