"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from belltower.operators import vectors
from belltower.sources.tables import table

QUERIES = {
    "vector_top_k": lambda s, d: vectors.self_top_k(table(s, d, "embeddings"), every=20, k=4),
    "unit_vectors": lambda s, d: table(s, d, "embeddings").select("vec_id", vectors.unit(F.col("embedding"), 96).alias("u")).select("vec_id", F.size("u").cast("long").alias("size"), F.round(vectors.norm(F.col("u")), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first")),
    "hash_embedding": lambda s, d: table(s, d, "benchmark").select("item_id", vectors.hash_embedding(F.col("text"), 64).alias("v")).select("item_id", F.round(F.element_at("v", 1), 9).alias("first"), F.round(F.element_at("v", 64), 9).alias("last"), F.round(vectors.norm(F.col("v")), 9).alias("length")),
}
ORACLE_SQL = {
    "vector_top_k": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS similarity
      FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, similarity, rank::INTEGER AS rank FROM r WHERE rank <= 4""",
    "unit_vectors": "SELECT vec_id, 96::BIGINT AS size, 1.0::DOUBLE AS length, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
}
