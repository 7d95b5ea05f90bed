"""Queries that keep stored tables up to date: documents stand for knowledge documents, their lines for chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belltower.operators.memo import Memo
from belltower.operators.reindex import StoredIndex
from belltower.operators.settings import as_of
from belltower.sources.stored import session_dir
from belltower.sources.tables import table

#: The embedding space of queries; documents of this source were embedded in another.
SPACE, OLD_SOURCE = "b", "src1"


def shape(texts: list[str]) -> list[list[float]]:
    """Stands in for an embedding service: characters, spaces, and one. It refuses texts with a bar."""
    if any("|" in t for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


def own_path(s: SparkSession) -> str:
    return f"{session_dir(s)}/{uuid.uuid4().hex}"


def stored_lines(s: SparkSession, d: str) -> StoredIndex:
    docs = table(s, d, "documents")
    space = F.when(F.col("source") == OLD_SOURCE, "a").otherwise(SPACE)
    states = docs.select(F.col("doc_id").alias("document_id"), F.lit("ready").alias("status"), F.to_json(F.struct(space.alias("embedding_space"), "lang")).alias("metadata_json"))
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).where("text <> ''").withColumn("page_number", F.lit(1))
    old = table(s, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return StoredIndex(s, own_path(s)).created(states, lines.join(old, "document_id", "left"))


def reindexed(s: SparkSession, d: str) -> DataFrame:
    """What documents and chunks hold after the stale ones were embedded anew."""
    stored = stored_lines(s, d)
    report = stored.reindexed(shape, SPACE, 3)
    sums = stored.chunks().groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.round(F.sum(F.col("embedding")[0]), 3).alias("total"))
    space, note = (F.get_json_object("metadata_json", f"$.{k}") for k in ("embedding_space", "error"))
    states = stored.documents().select("document_id", "status", space.alias("space"), note.alias("error"))
    tried = report.select("document_id", F.lit(True).alias("tried"))
    both = states.join(sums, "document_id", "left").join(tried, "document_id", "left")
    return both.select("document_id", "status", "space", "error", F.coalesce("tried", F.lit(False)).alias("tried"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"), "total")


def remembered(s: SparkSession, d: str) -> DataFrame:
    """Digests of messages by their text, looked up twice: assistants' first, then all, so that the second run computes only what the first hasn't."""
    rows = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    memo = Memo(s, own_path(s), "digest string, run int")

    def digests(run: int):
        return lambda keys: keys.select("key", F.md5(F.col("key").cast("binary")).alias("digest"), F.lit(run).alias("run"))

    memo.completed(rows.where("role = 'assistant'").select(F.col("text").alias("key")), digests(1))
    return memo.looked_up(rows, "text", digests(2)).select("conv_id", "turn", "digest", "run")


NAMES, DEFAULTS = ["view", "search", "error"], {"view": "0", "error": "none"}


def settings_at_start(s: SparkSession, d: str) -> DataFrame:
    """A user's views, searches and errors change settings of these names; clicks begin calls."""
    e = table(s, d, "events")
    value = F.when(F.col("value") >= 1, F.col("event_id").cast("string"))  # a small value takes the setting back
    calls = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    found = as_of(calls, e.select("user_id", "ts", F.col("event_type").alias("name"), value.alias("value")), "user_id", "ts", NAMES, DEFAULTS)
    return found.select("event_id", *(F.col("settings")[n].alias(n) for n in NAMES))


QUERIES = {"reindexed": reindexed, "keyed_results": remembered, "settings_at_start": settings_at_start}
ORACLE_SQL = {
    "reindexed": f"""WITH l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (contains(line, '|')) AS refused, sum(len(line)) AS chars FROM l GROUP BY 1),
s AS (SELECT d.doc_id, source, coalesce(n, 0) AS n, coalesce(refused, 0) AS refused, chars, CASE WHEN vec_id IS NULL THEN NULL ELSE embedding[1]::DOUBLE END AS old, coalesce(n, 0) = 0 OR vec_id IS NULL OR source IS NOT DISTINCT FROM '{OLD_SOURCE}' AS stale FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
z AS (SELECT *, stale AND (n = 0 OR refused > 0) AS failed, stale AND n > 0 AND refused = 0 AS renewed FROM s)
SELECT doc_id AS document_id, CASE WHEN failed THEN 'failed' ELSE 'ready' END AS status, CASE WHEN source IS NOT DISTINCT FROM '{OLD_SOURCE}' AND NOT renewed THEN 'a' ELSE '{SPACE}' END AS space, CASE WHEN failed THEN CASE WHEN n = 0 THEN 'no chunks' ELSE 'ValueError: refused' END END AS error, stale AS tried, n AS chunks,
CASE WHEN renewed OR old IS NOT NULL THEN n ELSE 0 END AS embedded, CASE WHEN n = 0 THEN NULL WHEN renewed THEN chars::DOUBLE ELSE round(old * n, 3) END AS total FROM z""",
    "keyed_results": "SELECT conv_id, turn, md5(text) AS digest, CASE WHEN text IS NULL THEN NULL WHEN text IN (SELECT text FROM conversations WHERE role = 'assistant') THEN 1 ELSE 2 END AS run FROM conversations",
    "settings_at_start": "WITH v AS (SELECT *, "
    + ", ".join(f"last_value(CASE WHEN event_type = '{n}' THEN event_id END IGNORE NULLS) OVER w AS i_{n}" for n in NAMES)
    + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END, CASE WHEN value >= 1 THEN event_id::VARCHAR END NULLS FIRST ROWS UNBOUNDED PRECEDING)) SELECT v.event_id, "
    + ", ".join(f"coalesce((SELECT CASE WHEN value >= 1 THEN e.event_id::VARCHAR END FROM events e WHERE e.event_id = i_{n}), {repr(DEFAULTS[n]) if n in DEFAULTS else 'NULL'}) AS {n}" for n in NAMES)
    + " FROM v WHERE event_type = 'click'",
}
