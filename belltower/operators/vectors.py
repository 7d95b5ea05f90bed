"""Exact vector search and vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belltower.sources.stored import settled

#: Queries and rows of a task; rows of one product; pairs that are compared at once.
BLOCK, SHARD, PART, PAIRS = 4000, 25_000, 1024, 50_000


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def top_k(embeddings: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The k rows (vec_id, embedding) most similar by cosine to each query row (query_id, q), the row of the same id left out; ties go to the lesser id.

    Queries in blocks meet rows in shards, each cell of the grid one matrix product in one task
    of one job: a row is sent once for each block of queries, a query once for each shard, and a
    cell sends k rows a query. The driver holds neither.
    Vectors of another size than the queries', of length zero, or null take no part.
    """
    q = queries.where(norm(F.col("q")) > 0)
    total, dims = q.agg(F.count("*"), F.max(F.size("q"))).first()
    dims = dims or 0
    blocks = max(-(-total // block), 1)
    shards = max(-(-embeddings.count() // shard), 1 if blocks > 1 else min(embeddings.sparkSession.sparkContext.defaultParallelism, 64))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where((F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    q = q.where(F.size("q") == dims).select(F.col("query_id").cast("long"), F.col("q").cast("array<double>"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            held = best_of(*(np.asarray(t.column(c).combine_chunks()) if c.endswith("id") else matrix(t.column(c), dims) for t, c in ((left, "vec_id"), (left, "embedding"), (right, "query_id"), (right, "q"))), k)
        return pa.table([pa.array(x) for x in held], names=["query_id", "vec_id", "similarity"])

    near = rows.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(-1, dims)


def best_of(own: np.ndarray, v: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, part: int = PART) -> list[np.ndarray]:
    """query_id, vec_id and similarity of the k best rows (own, v) for every query (ids, q), by products of parts of the rows."""
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    size = np.linalg.norm(v, axis=1)
    own, v = own[size > 0], v[size > 0] / size[size > 0][:, None]
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
    for at in range(0, len(v), part):
        some = own[at : at + part]
        for j, s in enumerate(np.round(q @ v[at : at + part].T, 6)):
            least = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -2.0
            near = np.flatnonzero(s >= least)
            near = near[some[near] != ids[j]]
            who, sim = np.concatenate([best[j][0], some[near]]), np.concatenate([best[j][1], s[near]])
            order = np.lexsort((who, -sim))[:k]
            best[j] = who[order], sim[order]
    return [np.repeat(ids, [len(w) for w, _ in best]), np.concatenate([w for w, _ in best]), np.concatenate([s for _, s in best])]


def self_top_k(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    """top_k of the rows whose id is divisible by `every`, against all rows."""
    q = embeddings.where((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull())
    return top_k(embeddings, q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)


def top_k_among(pairs: DataFrame, embeddings: DataFrame, k: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, vec_id, similarity): of the given pairs (query_id, vec_id), each once, the k most similar of every query or a few more; ids are rows of embeddings (vec_id, embedding).

    A row is sent once for each block of queries, with the list of those of the block that it is
    paired with; no pair carries a vector. The similarity of a vector of another size than the
    first query's, of length zero, or null is null and comes last; ties go to the lesser id.
    """
    spark, e, pairs = pairs.sparkSession, embeddings.select("vec_id", "embedding"), settled(pairs)
    asked = e.join(pairs.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    total, dims = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks = max(-(-total // block), 1)
    shards = max(-(-e.count() // shard), 1 if blocks > 1 else min(spark.sparkContext.defaultParallelism, 64))
    usable = lambda v: F.when((F.size(v) == F.lit(dims or 0)) & ~F.exists(v, lambda x: x.isNull()), v.cast("array<double>"))
    of = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    lists = pairs.groupBy("vec_id", of).agg(F.collect_list("query_id").alias("queries"))
    rows = lists.join(e, "vec_id").select("vec_id", "block", "queries", usable(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    q = asked.select("query_id", usable(F.col("q")).alias("v"), of).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        (v, good), (w, fine) = units(left.column("v"), dims or 0), units(right.column("v"), dims or 0)
        ids, own = np.asarray(right.column("query_id").combine_chunks(), np.int64), np.asarray(left.column("vec_id").combine_chunks(), np.int64)
        lists = left.column("queries").combine_chunks()
        row = np.repeat(np.arange(len(own)), np.diff(np.asarray(lists.offsets)))
        order = np.argsort(ids)
        asks = np.asarray(lists.flatten(), np.int64)
        at = np.minimum(np.searchsorted(ids, asks, sorter=order), max(len(ids) - 1, 0))
        known = ids[order[at]] == asks if len(ids) else np.zeros(len(asks), bool)  # queries that have a vector's row
        row, at = row[known], order[at[known]] if len(ids) else at[known]
        similarity = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", v[row[a : a + PAIRS]], w[at[a : a + PAIRS]]) for a in range(0, len(row), PAIRS))])
        similarity, null = np.round(similarity, 6), ~(good[row] & fine[at])
        fall = np.where(null, np.inf, np.where(np.isnan(similarity), -np.inf, -similarity))
        order = np.lexsort((own[row], fall, at))
        first = np.searchsorted(at[order], at[order])
        order = order[np.arange(len(order)) - first < k]
        return pa.table([pa.array(ids[at[order]]), pa.array(own[row[order]]), pa.array(similarity[order], mask=null[order])], names=["query_id", "vec_id", "similarity"])

    return rows.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, similarity double")


def units(column: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one, and which of them are neither null nor of length zero."""
    good = np.asarray(column.is_valid().combine_chunks().to_numpy(zero_copy_only=False), bool)
    v = np.zeros((len(good), dims))
    v[good] = matrix(column.drop_null(), dims) if good.any() else 0
    size = np.linalg.norm(v, axis=1)
    good = good & (size != 0)
    v[good] /= size[good][:, None]
    return v, good


def unit(v: Column, size: int) -> Column:
    """The vector at length one, padded with zeros to size; zero vectors stay."""
    n = norm(v)
    scaled = F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return F.concat(scaled, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(v), F.lit(0))))


def hash_embedding(text: Column, size: int) -> Column:
    """A deterministic vector of a text: big-endian 16-bit parts of SHA-256 over text and counter, scaled to -1..1, at length one."""
    per = 16
    raw = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit((size + per - 1) // per - 1)),
            lambda i: F.transform(
                F.sequence(F.lit(0), F.lit(per - 1)),
                lambda j: F.conv(F.substring(F.sha2(F.concat(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), F.unhex(F.lpad(F.hex(i), 8, "0"))), 256), j * 4 + 1, F.lit(4)), 16, 10).cast("double") / 32767.5 - 1,
            ),
        )
    )
    return unit(F.slice(raw, 1, size), size)
