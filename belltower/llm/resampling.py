"""Importance resampling towards a target distribution, over hashed n-gram features.

A text's features are its runs of one to n words, hashed to buckets. Counts of all features of
the corpus and of the target texts give each bucket a gain (log ratio of smoothed shares), and
a text's weight is the sum of its features' gains. Gumbel noise from a hash of the id is added
and the highest scores are drawn, which draws without replacement in proportion to the
exponential of the weights.

Long texts are cut at word boundaries into chunks with n - 1 words of the next as carry; a
chunk owns the features that start in its own words. Chunks of one text are dealt to all tasks
and their counts and weights are summed by text, so that neither a long text nor many of them
hold up a task; shorter texts are worked where they are read. Counts of buckets are summed in
each task first: what is shuffled and what reaches the driver are at most the buckets.

Cases: a null text has no words, weight 0 and a score, and isn't drawn; texts of fewer than
`least` words aren't drawn; a null id has the noise of an empty one and comes last among ties;
equal rows are scored and drawn as any two others; an empty target gives gains by the corpus
alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import fresh, partitions, settled, slices, utf8
from belltower.llm.sharding import ordered

RUN, BUCKETS, SEED, PERCENT, LEAST = 3, 10_000, 42, 5, 20
#: Bytes of a chunk; texts of more are cut.
CHUNK = 65_536
#: Share of rows beyond the drawn ones that the approximate cut leaves in, and the summary's accuracy (its error is a tenth of that).
SLACK, ACCURACY = 0.001, 10_000
#: A-Z to a-z, separators to a space; all bytes of other code points belong to words.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NEXT = re.compile(rb" *[^ ]+")


def chunks(text: bytes, size: int = CHUNK, run: int = RUN) -> Iterator[tuple[bytes, int]]:
    """(words of a chunk and its carry, words of the carry) of a text; each word is some chunk's own once."""
    text = text.translate(TO_WORDS)
    at = 0
    while at < len(text):
        end = text.find(b" ", min(at + size, len(text)))
        end = len(text) if end < 0 else end
        stop, carry = end, 0
        while carry < run - 1 and (word := NEXT.match(text, stop)):
            stop, carry = word.end(), carry + 1
        yield text[at:stop], carry
        at = end


def buckets_of(text: bytes, carry: int = 0, run: int = RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The chunk's own words, and the bucket of every run that starts at one of them."""
    words = text.translate(TO_WORDS).split()
    own = len(words) - carry
    sums = list(map(zlib.crc32, words))
    found, spaced = [sums[:own]], [b" " + w for w in words]
    for k in range(1, run):  # the checksum of a run goes on from that of its first words
        sums = list(map(zlib.crc32, spaced[k:], sums))
        found.append(sums[:own])
    return own, np.concatenate([np.array(f, np.uint32) for f in found]) % np.uint32(buckets)


def dealt(texts: DataFrame, size: int = CHUNK, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Rows with text as (row, data, carry) beside their other columns: those of up to `size` bytes whole where they are, and the others as chunks over all tasks."""
    others = [n for n in texts.columns if n != "text"]
    rows = texts.select(*others, F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    short = rows.where(F.octet_length("data") <= size).withColumn("carry", F.lit(0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                head = b.slice(i, 1)
                for k, (part, carry) in enumerate(chunks(head.column("data")[0].as_py(), size, run)):
                    yield pa.RecordBatch.from_arrays([*(head.column(n) for n in (*others, "row")), pa.array([part]), pa.array([carry], pa.int32()), pa.array([k], pa.int32())], names=[*others, "row", "data", "carry", "part"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in short.schema)
    long = rows.where(F.octet_length("data") > size).mapInArrow(cut, f"{types}, part int")
    return short, long.repartition(partitions(texts.sparkSession), "row", "part").drop("part")


def features(b: pa.RecordBatch, run: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    return [buckets_of(data, carry, run, buckets) for data, carry in zip(utf8(b.column("data")), b.column("carry").to_pylist(), strict=True)]


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS, size: int = CHUNK) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b, 128):
                total += np.bincount(np.concatenate([x for _, x in features(part, run, buckets)]), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    short, long = (part.select("data", "carry").mapInArrow(count, "bucket int, n long") for part in dealt(texts.select("text"), size, run))
    out = np.zeros(buckets, np.int64)
    for r in short.unionByName(long).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target to corpus, rounded down."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN, size: int = CHUNK) -> DataFrame:
    """Every row's columns beside text, with its n_words, n_features and weight; none of the columns may be of these names, or row, data or carry."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    others = [n for n in docs.columns if n != "text"]
    sums = ["n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 128):
                found = features(part, run, buckets)
                made = [[own for own, _ in found], [len(x) for _, x in found], [int(shared.value[x].sum()) for _, x in found]]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in (*others, "row")), *(pa.array(m, pa.int64()) for m in made)], names=[*others, "row", *sums])

    short, long = dealt(docs, size, run)
    types = ", ".join(f"`{n}` {short.schema[n].dataType.simpleString()}" for n in (*others, "row")) + ", n_words long, n_features long, weight long"
    chunked = long.mapInArrow(weigh, types).groupBy("row").agg(*(F.first(n).alias(n) for n in others), *(F.sum(n).alias(n) for n in sums))
    return short.mapInArrow(weigh, types).unionByName(chunked).drop("row")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of standard Gumbel noise, rounded down, from a hash of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """rows (doc_id, n_words, score and others) and their rank: 1, 2, ... for the highest scores among texts of `least` words, as many as the percentage of these; null for the others."""
    rows = settled(rows.withColumn("__tie", F.monotonically_increasing_id()))
    may = F.col("n_words") >= least
    share = 1 - percent / 100 - SLACK
    seen = rows.where(may).agg(F.count("*").alias("n"), F.percentile_approx("score", max(share, 0.0), ACCURACY).alias("cut")).first()
    drawn = percent * seen["n"] // 100
    if not drawn:
        return rows.drop("__tie").withColumn("rank", F.lit(None).cast("long"))
    high = may & (F.col("score") >= seen["cut"])
    if rows.where(high).count() < drawn:  # the cut is approximate; it only spares the sort rows that can't be drawn
        high = may
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__tie")]
    numbered = ordered(rows.where(high), order, {"rank": F.lit(1).cast("long")})
    numbered = numbered.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return numbered.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long"))).drop("__tie")


def scored(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight, score) of every row of docs; target: texts of the wanted distribution; key: a hash of the row's id and text."""
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    rows = weighed(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text"), gain, run)
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """The drawn rows of docs with all their columns; of equal rows all come if one is drawn."""
    names = docs.columns
    mark = fresh(names, "__key")
    chosen = ranked(scored(docs, target), percent, least).where("rank IS NOT NULL").select(F.col("key").alias(mark)).distinct()
    return docs.withColumn(mark, F.xxhash64("doc_id", "text")).join(chosen, mark, "left_semi").select(*names)


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return ranked(scored(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")
