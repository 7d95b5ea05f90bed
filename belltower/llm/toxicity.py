"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

Each class has an interpolated bigram model with one absolute discount. A bigram backs off to
the class's continuation counts (after how many distinct words a word occurs), and these to
continuation counts of both classes together, which back off to all words alike; each level
gets what the discount and the cutoff take from the one above, so that every distribution
sums to one. Cutoff: an expression that too small a share of a class's texts holds, or not
clearly more of them than of the other class's, has no probability of its own in the class's
model and is smoothed through the shared counts. (Without cutoff the models are the textbook's;
on texts of mostly rare words the difference of their likelihoods is then little but noise,
see README.) A text's evidence is the difference of its log-likelihoods under both models,
divided by its number of tokens. A logistic curve that rises with it turns it into a score; it
is fitted on labelled texts, each half with the evidence that models of the other half give.

An expression counts once for each distinct text. Labels are learned from at most `max_rows` texts of each class (documented bound, the first
by a hash of doc_id); the share of toxic labels is taken over all of them.

Cases: a null or empty text has no tokens and gets the score of one that holds only what is
left to shared counts; a null label
or doc_id teaches nothing; of repeated labels of a doc_id the largest counts; repeated rows
give repeated results; without labels of both classes the score is 0; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import by_batch, fresh, settled, texts

WORD = re.compile(r"\w+")
#: The absolute discount of all counts.
DISCOUNT = 0.75
#: Cutoff: the least share of a class's texts and the least numbers of texts that hold a word and a bigram, and how many times as many as of the other class's, brought to one size.
SHARE, TEXTS, PAIR_TEXTS, TIMES = 0.02, 4, 12, 3.0
#: Least slope of the logistic curve for a hundredth of evidence: the score always rises with it.
SLOPE = 1e-3
MAX_ROWS = 3000
#: Values of the hash that orders labelled rows for the sample.
PLACES = 1 << 40
FOLDS, HELD = 5, 0


@dataclass
class Model:
    """Log ratios, toxic to ordinary: of what both models leave to shared counts (base), what a word adds to it, what a word pair adds to its word, and what a word changes in all that follows it in no listed pair."""

    base: float
    word: dict[str, float]
    pair: dict[tuple[str, str], float]
    after: dict[str, float]
    bias: float = 0.0
    slope: float = SLOPE


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD


def evidence(model: Model, docs: list[str]) -> np.ndarray:
    """Hundredths of difference of the log-likelihoods for each token of each text."""
    word, pair, after = model.word.get, model.pair, model.after
    out = np.full(len(docs), 100 * model.base)
    for k, text in enumerate(docs):
        w = WORD.findall(text.lower())
        if w:
            total = len(w) * model.base + sum(r for x in w if (r := word(x)))
            if pair:
                total += sum(pair[x] if x in pair else after.get(x[0], 0.0) for x in zip(["", *w], w, strict=False) if x[0] in after)
            out[k] = 100 * total / len(w)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope, at least SLOPE, of a logistic regression by Newton steps."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(b[0]), float(b[1])) if b[1] > SLOPE else (float(np.log(y.mean() / (1 - y.mean()))), SLOPE)


def counted(rows: DataFrame) -> DataFrame:
    """(previous, word, o0, t0, o1, t1): in how many texts of each class (ordinary, toxic) and half a bigram occurs; previous is empty for a first word, and null where the word itself is counted."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        v, w, c, h = [], [], [], []
        for text, toxic, half in zip(texts(b.column("text")), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
            words = WORD.findall(text.lower())
            found = [*set(zip(["", *words], words, strict=False)), *((None, x) for x in set(words))]
            v += [x for x, _ in found]
            w += [x for _, x in found]
            c += [toxic] * len(found)
            h += [half] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(w, pa.string()), pa.array(c, pa.int32()), pa.array(h, pa.int32())], names=["previous", "word", "toxic", "half"])

    pairs = by_batch(rows, f, "previous string, word string, toxic int, half int")
    return pairs.groupBy("previous", "word").agg(*(F.count_if((F.col("toxic") == t) & (F.col("half") == h)).alias(f"{'ot'[t]}{h}") for h in (0, 1) for t in (0, 1)))


def kept(size: tuple[int, int], share: float, least: tuple[int, int], times: float) -> tuple[Column, Column]:
    """Whether the ordinary (o) and the toxic (t) count of an expression stays, of classes of so many texts."""
    low = F.when(F.col("previous").isNull(), max(least[0], share * min(size))).otherwise(max(least[1], share * min(size)))
    o, t = (F.col(c) * (min(size) / n) for c, n in zip("ot", size, strict=True))
    return (F.col("o") > 0) & (o >= low + times * t), (F.col("t") > 0) & (t >= low + times * o)


def model_of(counts: DataFrame, size: tuple[int, int], share: float = SHARE, least: tuple[int, int] = (TEXTS, PAIR_TEXTS), times: float = TIMES) -> Model | None:
    """The models of counts (previous, word, o, t) from so many ordinary and toxic texts; None where a class has none.

    Sums and cutoffs are Spark's; the driver gets what the cutoff leaves, which is at most the
    expressions of a text divided by the share, with their words' shared counts.
    """
    if not all(size):
        return None
    keep_o, keep_t = kept(size, share, least, times)
    held = counts.where(keep_o | keep_t).select("previous", "word", F.when(keep_o, F.col("o")).otherwise(0).alias("o"), F.when(keep_t, F.col("t")).otherwise(0).alias("t"))
    held = settled(held)
    pairs = counts.where("previous IS NOT NULL AND o + t > 0")
    # continuation counts of every word, and those of words that the driver needs
    lower = settled(pairs.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("o") > 0).alias("o"), F.count_if(F.col("t") > 0).alias("t")))
    total = lower.agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("o").alias("o"), F.sum("t").alias("t")).first()
    told = {r["word"]: r for r in lower.join(held.select("word").distinct(), "word", "left_semi").collect()}
    listed = held.where("previous IS NOT NULL").collect()
    heads = pairs.join(held.where("previous IS NOT NULL").select("previous").distinct(), "previous", "left_semi").groupBy("previous").agg(F.sum("o").alias("o"), F.sum("t").alias("t")).collect()
    context = {r["previous"]: r for r in heads}
    each = DISCOUNT * total["kinds"] / (total["kinds"] + 1)  # of the discounted mass, for every known word and for all unknown ones
    shared = lambda w: (told[w]["n"] - DISCOUNT + each) / total["n"]
    words = held.where("previous IS NULL").collect()
    own = [{r["word"]: (told[r["word"]][c] - DISCOUNT) / total[c] for r in words if r[c]} for c in "ot"]
    left = [1 - sum(p.values()) for p in own]
    # where nothing is cut off, all of a word's mass is the class's own and what is left is what the discount took
    base = float(np.log(left[1] / left[0]))
    below = lambda k, w: own[k].get(w, 0.0) + left[k] * shared(w)
    model = Model(base, {w: float(np.log(below(1, w) / below(0, w))) - base for w in own[0] | own[1]}, {}, {})
    above: list[dict] = [{(r["previous"], r["word"]): (r[c] - DISCOUNT) / context[r["previous"]][c] for r in listed if r[c]} for c in "ot"]
    rest: list[dict[str, float]] = [dict.fromkeys(context, 1.0), dict.fromkeys(context, 1.0)]
    for k in (0, 1):
        for (v, _), p in above[k].items():
            rest[k][v] -= p
    model.after = {v: float(np.log(rest[1][v] / rest[0][v])) for v in context}
    for v, w in above[0] | above[1]:
        p = [above[k].get((v, w), 0.0) + rest[k][v] * below(k, w) for k in (0, 1)]
        model.pair[v, w] = float(np.log(p[1] / p[0])) - base - model.word.get(w, 0.0)
    return model


def models(counts: DataFrame, sizes: dict[tuple[int, int], int]) -> list[Model | None]:
    """The models of the first half, of the second, and of both; sizes: texts by (class, half)."""
    made = []
    for o, t, halves in (("o0", "t0", (0,)), ("o1", "t1", (1,)), ("o0 + o1", "t0 + t1", (0, 1))):
        size = tuple(sum(sizes.get((c, h), 0) for h in halves) for c in (0, 1))
        made.append(model_of(counts.select("previous", "word", F.expr(o).alias("o"), F.expr(t).alias("t")).where("o + t > 0"), size))
    return made


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """The model, from labelled texts whose fold isn't held out; None without both classes. What reaches the driver is bounded by max_rows texts a class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    # hashes that can't be among the first of a class are left out where they are read
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    first = [known.where((F.col("toxic") == c) & (place < min(PLACES, -(-4 * max_rows * PLACES // share[c])))).orderBy(place, "doc_id").limit(max_rows) for c in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(first[0].union(first[1])), "doc_id").where(F.length("text") > 0)
    # one row for each distinct text, so that copies neither count twice nor sit in both halves
    chosen = settled(chosen.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod("key", F.lit(2)).cast("int").alias("half")))
    sizes = {(r["toxic"], r["half"]): r["count"] for r in chosen.groupBy("toxic", "half").count().collect()}
    *halves, model = models(settled(counted(chosen)), sizes)
    if model is None or None in halves:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        found, half = texts(b.column("text")), np.asarray(b.column("half"))
        x = np.where(half == 0, evidence(shared.value[1], found), evidence(shared.value[0], found))
        return pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x)], names=["toxic", "x"])

    fit = by_batch(chosen, f, "toxic int, x double").toPandas().sort_values(["x", "toxic"])
    y = fit["toxic"].to_numpy(float)
    model.bias, model.slope = logistic(fit["x"].to_numpy(), y)
    # the sample has its own share of toxic texts; the score speaks of the share in all labels
    model.bias += np.log(share[1] / share[0]) - np.log(y.mean() / (1 - y.mean()))
    return model


def scored(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns, and as `name` the score of each whole text between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        found = texts(b.column("text"))
        s = np.zeros(len(found)) if m is None else 1 / (1 + np.exp(-np.clip(m.bias + m.slope * evidence(m, found), -500, 500)))
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s)], names=[*keep, name])

    kept = docs.select(*dict.fromkeys((*keep, "text")))
    types = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(kept, f, f"{types}, `{name}` double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = scored(docs, trained(docs, labels))
    return s.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores at or above the threshold; columns and other rows stay as they are."""
    names = docs.columns
    mark = fresh(names, "__toxic")
    return scored(docs, trained(docs, labels), tuple(names), mark).where(F.col(mark) < threshold).select(*names)
