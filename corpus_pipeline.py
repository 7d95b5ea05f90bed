"""A training-corpus pipeline over `documents`: each stage works on what the one before kept.

Cases: a null or empty text passes every stage (it isn't toxic, has no lines, links with
nothing and holds no window) and ends with 0 tokens; a document whose lines all repeat
earlier ones stays with an empty text; of repeated rows and of texts that link the one of the
least doc_id stays (a null doc_id only where there is no other); ties between lines go to the
least doc_id and line number; without labels of both classes nothing is toxic; empty tables
give an empty result; columns beside those of documents pass through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from belltower.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from belltower.llm.common import bounded_batches, read, settled

VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. As the first stage it also bounds the Arrow batches of all that follow."""
    bounded_batches(spark)
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines only the first stays; documents stay, with n_chars of their new text."""
    return line_dedup.without_duplicates(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_only(docs, read(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document that is left."""
    return bpe.digest(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("decontamination", decontaminated),
    ("bpe", tokenized),
]

#: The model of the first stage and the tokenizer of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
