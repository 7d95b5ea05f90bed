"""What the llm operators share: scans, tables that cut lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belltower.sources.stored import settled as settled
from belltower.sources.tables import BATCH_ROWS as BATCH_ROWS
from belltower.sources.tables import bounded_batches as bounded_batches


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str], wanted: str) -> str:
    """The wanted column name, lengthened until no column has it."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what a task makes of it at a time stays small."""
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


#: What this worker process keeps between tasks, by operator: how it is let go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """Says that this process keeps memory for the tasks of an operator."""
    _KEPT[operator] = forget


def lets_go(operator: str | None = None) -> None:
    """Lets go of what this process keeps for other operators than the one whose task begins."""
    for name in [n for n in _KEPT if n != operator]:
        _KEPT.pop(name)()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def gives_back() -> None:
    """Returns to the system what this process has freed: an idle worker would hold it for its executor's next stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, operator: str | None = None) -> DataFrame:
    """mapInArrow whose worker holds nothing for other operators, and when its task is done nothing that is freed. operator: whose kept memory run uses."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lets_go(operator)
        yield from run(batches)
        gives_back()

    return df.mapInArrow(bounded, schema)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, operator: str | None = None) -> DataFrame:
    """Applies f to the rows in Arrow batches of a few hundred. operator: whose kept memory f uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                if (out := f(part)) is not None and out.num_rows:
                    yield out

    return in_arrow(df, run, schema, operator)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads the bits of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def fits(df: DataFrame, size: Column, max_bytes: int) -> bool:
    """Whether df's rows, of the given sizes in bytes, come to at most max_bytes."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes
