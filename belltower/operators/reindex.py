"""Incremental re-index: chunks of stale documents are embedded anew, checked, and replaced; everything else stays as it is on disk."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belltower.operators.reporting import index_status, merged_json
from belltower.sources.stored import settled

#: Texts that an embedder is given at a time; folders of a stored index.
BATCH, BUCKETS = 32, 64
#: Chunks of one document in a file, at most.
FILE = 100_000
CHUNKS = "document_id long, chunk_index int, page_number int, text string, embedding array<double>"
Embedder = Callable[[list[str]], list[list[float]]]


def vectors_of(texts: list[str], embed: Embedder, size: int) -> list[list[float]]:
    """Vectors of a batch of texts. ValueError unless there is one of `size` finite numbers for each."""
    found = [list(v) for v in embed(texts)]
    if len(found) != len(texts):
        raise ValueError(f"{len(found)} vectors for {len(texts)} chunks")
    for v in found:
        if len(v) != size or not all(math.isfinite(x) for x in v):
            raise ValueError(f"a vector of {len(v)} numbers that isn't {size} finite ones")
    return found


def embedded(chunks: DataFrame, embed: Embedder, size: int, batch: int = BATCH) -> DataFrame:
    """chunks (of CHUNKS) with new embeddings, or with why they have none as `error`.

    Batches run across documents. One that fails is tried again document by document, so that
    a document's failure stays its own; embedders must not mind being asked twice.
    """

    def attempt(rows: list[dict]) -> Iterator[tuple[list[float] | None, str | None]]:
        try:
            yield from ((v, None) for v in vectors_of([r["text"] or "" for r in rows], embed, size))
        except Exception as e:  # an embedder is foreign code: whatever it raises is the documents' error
            if rows[0]["document_id"] == rows[-1]["document_id"]:
                yield from ((None, f"{type(e).__name__}: {e}") for _ in rows)
            else:
                for _, own in groupby(rows, key=lambda r: r["document_id"]):
                    yield from attempt(list(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                made = list(attempt(part.select(["document_id", "text"]).to_pylist()))
                columns = [*(part.column(c) for c in ("document_id", "chunk_index", "page_number", "text")), pa.array([v for v, _ in made], pa.list_(pa.float64())), pa.array([e for _, e in made], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["document_id", "chunk_index", "page_number", "text", "embedding", "error"])

    # by document, so that a retry meets whole runs of one document
    return chunks.select("document_id", "chunk_index", "page_number", "text").sortWithinPartitions("document_id", "chunk_index").mapInArrow(run, f"{CHUNKS}, error string")


class StoredIndex:
    """Chunks (of CHUNKS) and documents (document_id, status, metadata_json) as Parquet at `path`, in folders by a hash of document_id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int"))

    def _replace(self, rows: DataFrame, name: str) -> None:
        """The folders that rows fall into, and no others, hold these rows alone from the write's commit on. Until then they are written beside what is there, which rows can be read from."""
        # a document of very many chunks is several files
        by = ["bucket", F.floor(F.col("chunk_index") / FILE)] if "chunk_index" in rows.columns else ["bucket"]
        self._bucketed(rows).repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")

    def created(self, documents: DataFrame, chunks: DataFrame) -> StoredIndex:
        self._replace(documents.select("document_id", "status", "metadata_json"), "documents")
        self._replace(chunks.select("document_id", "chunk_index", "page_number", "text", "embedding"), "chunks")
        return self

    def documents(self) -> DataFrame:
        return self._read("documents", "document_id long, status string, metadata_json string")

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def status(self, space: str, documents: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
        """documents, chunks: those of this index, for a caller that has read them."""
        documents = self.documents() if documents is None else documents
        return index_status(documents.drop("bucket"), self.chunks() if chunks is None else chunks, space)

    def reindexed(self, embed: Embedder, space: str, size: int, only_stale: bool = True, pages: DataFrame | None = None) -> DataFrame:
        """Embeds the chunks of stale (or all) documents and replaces those of every document that came through whole; returns (document_id, chunks, error), a row for each document that was tried.

        Nothing stored changes before all new vectors are written beside it and checked. A
        document with any failed chunk, or without chunks, keeps what it had and gets status
        failed and the error. pages (document_id, chunk_index, page_number, text): chunks to be
        made for documents that have none stored. Folders without a changed document are neither
        read nor written.
        """
        documents, stored = self.documents(), self.chunks()
        wanted = self.status(space, documents, stored)
        wanted = settled((wanted.where("stale") if only_stale else wanted).select("document_id", F.col("chunk_count") == 0).toDF("document_id", "bare"))
        old = stored.join(wanted, "document_id", "left_semi").select("document_id", "chunk_index", "page_number", "text")
        if pages is not None:
            old = old.unionByName(pages.join(wanted.where("bare"), "document_id", "left_semi").select("document_id", "chunk_index", "page_number", "text"))
        staged = settled(embedded(old, embed, size))
        told = staged.groupBy("document_id").agg(F.count("*").alias("chunks"), F.min("error").alias("error"))
        report = wanted.select("document_id").join(told, "document_id", "left").select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(F.col("chunks").isNull(), "no chunks").otherwise(F.col("error")).alias("error"))
        report = settled(report)
        well = F.col("error").isNull()
        touched = self._bucketed(report).groupBy("bucket").agg(F.bool_or(well).alias("well")).collect()  # at most one for each folder
        if at := sorted(r["bucket"] for r in touched if r["well"]):
            kept = stored.where(F.col("bucket").isin(at)).join(report.where(well), "document_id", "left_anti").drop("bucket")
            # documents with failed chunks are few as a rule, and a table of their own tells Spark so: the others' new rows needn't be shuffled to be found
            failed = settled(report.where(~well & (F.col("chunks") > 0)).select("document_id"))
            self._replace(kept.unionByName(staged.join(failed, "document_id", "left_anti").select(*kept.columns)), "chunks")
        if at := sorted(r["bucket"] for r in touched):
            note = F.to_json(F.struct(F.lit(space).alias("embedding_space"), F.lit(size).cast("string").alias("embedding_dimensions"), F.col("chunks").cast("string").alias("chunk_count")))
            merged = merged_json(F.col("metadata_json"), F.when(well, note).otherwise(F.to_json(F.struct("error"))))
            # a document that is well again loses its old error
            merged = F.to_json(F.map_filter(merged, lambda k, v: ~well | (k != "error")))
            both, tried = documents.where(F.col("bucket").isin(at)).join(report, "document_id", "left"), F.col("chunks").isNotNull()
            status = F.when(~tried, F.col("status")).when(well, "ready").otherwise("failed")
            self._replace(both.select("document_id", status.alias("status"), F.when(tried, merged).otherwise(F.col("metadata_json")).alias("metadata_json")), "documents")
        return report
