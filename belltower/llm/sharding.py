"""Shards along a Hilbert curve over metadata.

Each row's metadata is quantised to a point, rows are sorted by the point's index on the
Hilbert curve, and the order is cut into runs of near-equal bytes, so that a filter on any
of the dimensions meets few shards. Rows of equal text are one group with one point, and a
group is never cut unless equal sizes can't be had otherwise: groups of more than LARGE of a
shard are placed first, each whole in the shard nearest to its point that has room; one that
no shard has room for, which alone would break the law, is dealt to several. The others fill
what room is left, along the curve.

Cases: a null text counts as empty with one byte; null metadata has the lowest coordinate;
rows that are equal in everything are told apart by their place in the order only; with
fewer groups than shards some shards are empty; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belltower.llm.common import fresh, partitions, settled

BITS = 5
#: Groups above this part of a shard's bytes, or of this part of all rows, are placed one by one: at most shards / LARGE + 1 / MANY groups, with at least SOME rows each in the latter case.
LARGE, MANY, SOME = 0.01, 0.001, 1000


def curve_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of points (n, dims), coordinates below 2**bits, by the transpose method."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray encode
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def with_curve(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """df and the Hilbert index of its integer columns `dims`."""

    def run(batches):
        for b in batches:
            points = np.column_stack([np.asarray(b.column(d).fill_null(0)) for d in dims])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve_index(points, bits), pa.int64())], names=[*b.schema.names, "curve"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{types}, curve long")


def quantised(c: Column, bits: int = BITS) -> Column:
    """A name as a coordinate: equal names meet, null is 0."""
    return F.coalesce(F.pmod(F.crc32(c.cast("binary")), F.lit((1 << bits) - 1)) + 1, F.lit(0)).cast("int")


def levels(size: Column, bits: int = BITS) -> Column:
    """A size as a coordinate: two steps for each doubling."""
    return F.least(F.greatest(F.floor(F.log2(size) * 2) - 8, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def ordered(rows: DataFrame, order: list[str], sums: dict[str, Column], within: str | None = None) -> DataFrame:
    """rows with, for each of the sums, its total over the rows before in the order (and of the same `within`).

    Running totals come from a range-partitioned sort: each partition sums its own rows and
    the sums of whole partitions (few rows each) give the offsets, so no task sees all rows.
    """
    keys = [within] if within else []
    ranged = settled(rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part", *keys).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the sort (and each `within` there)
    offsets = parts.select("__part", *keys, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    w = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = ranged.join(F.broadcast(offsets), ["__part", *keys])
    return both.select(*rows.columns, *((F.col(f"__{n}") + F.sum(c).over(w) - c).alias(n) for n, c in sums.items()))


def placed(large: list, before: dict[int, int], target: float, shards: int) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Where large groups go, as (number, first row of the group, rows, shard), and what room they leave in each shard. before: bytes of all rows below each curve index."""
    room = [target] * shards
    out = []
    for i in sorted(range(len(large)), key=lambda i: (-large[i]["n"] * large[i]["size"], large[i]["curve"], large[i]["key"])):
        g = large[i]
        near = sorted(range(shards), key=lambda s: (abs(s + 0.5 - before.get(g["curve"], 0) / target), s))
        whole = [s for s in near if room[s] >= g["n"] * g["size"]]
        first = 0
        for s in whole[:1] or near:
            rows = g["n"] if whole else min(g["n"] - first, max(0, int(room[s] // g["size"])))
            if rows:
                out.append((i, first, rows, s))
                room[s] -= rows * g["size"]
                first += rows
        while first < g["n"]:  # less than a row of room is left anywhere
            s = max(range(shards), key=lambda s: room[s])
            out.append((i, first, 1, s))
            room[s] -= g["size"]
            first += 1
    return out, [max(x, 0.0) for x in room]


def assigned(docs: DataFrame, shards: int = 16, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row; more: also row_key, a hash of its id and text."""
    spark, group = docs.sparkSession, ["key", "text_crc32", "size"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settled(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *([F.xxhash64("doc_id", "text").alias("row_key")] if more else [])))
    # one point for each group of equal texts; partial sums keep a large group from meeting in one task
    groups = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    points = groups.withColumn("a", quantised(F.col("lang"))).withColumn("b", quantised(F.col("source"))).withColumn("c", levels(F.col("size"))).select(*group, "n", "a", "b", "c")
    points = settled(with_curve(points, ["a", "b", "c"]).drop("a", "b", "c"))
    total = points.agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows")).first()
    target = max((total["bytes"] or 0) / shards, 1.0)
    is_large = (F.col("n") > 1) & ((F.col("n") * F.col("size") > LARGE * target) | (F.col("n") > max(SOME, MANY * (total["rows"] or 0))))
    large = points.where(is_large).orderBy("key", "text_crc32", "size").collect()  # bounded, see LARGE
    below = points.groupBy("curve").agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).orderBy("curve").collect()  # at most a row for each index of the curve
    starts = np.cumsum([0, *(r["bytes"] for r in below)])
    places, room = placed(large, {r["curve"]: int(x) for r, x in zip(below, starts, strict=False)}, target, shards)
    # the other groups, by the middle of each in the room that is left
    cuts = np.cumsum(room)
    run = ordered(points.where(~is_large), ["curve", *group], {"from": F.col("n") * F.col("size"), "row": F.col("n")})
    middle = F.col("from") + F.col("n") * F.col("size") / 2
    run = settled(run.withColumn("shard", F.least(F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= middle)), F.lit(shards - 1))))
    heads = {r["shard"]: r for r in run.groupBy("shard").agg(F.min("row").alias("first"), F.sum("n").alias("n")).collect()}
    first = spark.createDataFrame([(s, r["first"]) for s, r in heads.items()], "shard int, first long")
    small = rows.select("doc_id", *group, *more).join(run.join(F.broadcast(first), "shard"), group)
    # groups of one row need no order, and the others here are of a bounded number of rows
    index = F.when(F.col("n") > 1, F.row_number().over(Window.partitionBy(*group).orderBy("doc_id")) - 1).otherwise(0)
    small = small.select("doc_id", "size", "text_crc32", *more, "curve", "shard", (F.col("row") - F.col("first") + index).alias("slot"))
    if not large:
        return small
    names = F.broadcast(spark.createDataFrame([(r["key"], r["text_crc32"], r["size"], r["curve"], i) for i, r in enumerate(large)], "key long, text_crc32 long, size long, curve long, number int"))
    used = {s: r["n"] for s, r in heads.items()}
    slots = []
    for i, start, n, s in places:
        slots.append((i, start, start + n, s, used.get(s, 0)))
        used[s] = used.get(s, 0) + n
    where = F.broadcast(spark.createDataFrame(slots, "number int, start long, stop long, shard int, base long"))
    numbered = ordered(rows.join(names, group).select("doc_id", "size", "text_crc32", *more, "curve", "number"), ["doc_id"], {"index": F.lit(1)}, "number")
    told = numbered.join(where, "number").where((F.col("index") >= F.col("start")) & (F.col("index") < F.col("stop")))
    return small.unionByName(told.select("doc_id", "size", "text_crc32", *more, "curve", "shard", (F.col("base") + F.col("index") - F.col("start")).alias("slot")))


def query(docs: DataFrame) -> DataFrame:
    return assigned(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes docs with all their columns as one folder for each shard, rows in curve order, each in as many files as ranges of slots, so that readers prune folders and files by lang, source and size.

    The folders' column is called shard, or the next free name if docs has that. Rows of one id
    and text are alike to the curve: they go to the shard and slot of one of them.
    """
    names = docs.columns
    key, shard, slot = (fresh(names, n) for n in ("__key", "shard", "__slot"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    at = assigned(docs, shards, ("row_key",)).groupBy(F.col("row_key").alias(key)).agg(F.min(F.struct("shard", "slot")).alias("p")).select(key, F.col("p.shard").alias(shard), F.col("p.slot").alias(slot))
    rows = keyed.join(at, key).drop(key)
    rows.repartitionByRange(max(shards, partitions(docs.sparkSession)), shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
