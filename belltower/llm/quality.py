"""Document quality by Bradley-Terry ranking of pairs of labelled texts.

A text is told by measures of its shape alone (shares of kinds of characters, repetition of
words, runs and lengths), each cut to the range of the labelled texts and given as a few
hinges, so that nothing beyond that range counts more than its border. A preference pair is a
text of good quality and one of bad; the score's weights minimise the logistic loss of the
difference of both texts' features, so that better texts score higher. Texts are then kept or
not by a quantile of the scores of labelled texts: as many of them fall below the threshold as
have bad labels. What is returned is a logistic curve of the distance from the threshold.

All labelled texts outside the held-out fold are learned from: quantiles are exact, found by
counting in passes over the stored measures, and weights by Newton steps whose slopes and
curvatures are summed in the tasks. Each text of the larger class meets `ROUNDS` others; texts
are dealt to buckets of bounded size for that, and those of a much smaller class stand in several.

Cases: a null or empty text has the measures of no characters and gets their score; a null
label or doc_id teaches nothing; of repeated labels of a doc_id the least counts; repeated rows
give repeated results; equal scores fall on one side of the threshold together; without labels
of both classes all scores are 1 (no text is known to be bad); empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import by_batch, fresh, settled, texts

FOLDS, HELD = 3, 1
ROUNDS = 8
#: Texts of the larger class in a bucket, about, and how many of the smaller one it has at least if there are so many.
BUCKET, FEW = 2500, 250
#: Labels up to which they are sent to the texts; beyond, measures are sent to them.
SENT = 500_000
#: Quantiles of a measure at which its hinges stand.
KNOTS = (0.1, 0.5, 0.9)
#: Weight of the squared weights in the loss of a pair, on standardised features.
RIDGE = 1e-3
#: Scores of 0.5 and of 0.731 are a tenth of the range between the middles of both classes apart.
SPREAD = 0.1
SPACE, LETTER, UPPER, DIGIT, POINT, SIGN = range(6)
LISTED = 0x3000
#: Words that a text is taken to have besides its own where shares of repetition are told: few words can't show it.
RARE = 10
MEASURES = ("upper", "digits", "points", "signs", "doubled", "distinct", "commonest", "again", "stutter", "length", "long", "bare")


def kinds() -> np.ndarray:
    """The kind of every code point below LISTED, and of all others, which count as letters."""
    out = np.full(LISTED + 1, LETTER, np.uint8)
    for c in range(LISTED):
        x = chr(c)
        out[c] = SPACE if x.isspace() else UPPER if x.isupper() else LETTER if x.isalpha() else DIGIT if x.isdigit() else POINT if x in ".,;:!?'\"()-" else SIGN
    return out


KINDS = kinds()


def measures(text: str) -> np.ndarray:
    """The measures of a whole text, in the order of MEASURES; of a text without words zeros."""
    out = np.zeros(len(MEASURES))
    words = text.split()
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = KINDS[np.minimum(codes, LISTED)]
    count = np.bincount(kind, minlength=6)
    letters, marks, filled = count[LETTER] + count[UPPER], count[POINT] + count[SIGN], len(codes) - count[SPACE]
    ink = kind >= POINT
    doubled = int((ink[1:] & (codes[1:] == codes[:-1])).sum())
    n = len(words)
    times: dict[str, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    stutter = sum(map(str.__eq__, words, words[1:]))
    out[:] = (
        count[UPPER] / max(letters, 1),
        count[DIGIT] / filled,
        count[POINT] / filled,
        count[SIGN] / filled,
        doubled / max(marks, 1),
        1 - np.log(len(times)) / np.log(n) if n > 1 else 0.0,
        (max(times.values()) - 1) / (n + RARE),
        max(n - 2 - triples, 0) / (n + RARE),
        stutter / (n + RARE),
        np.log(filled / n),
        np.log1p(n),
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n,
    )
    return out


@dataclass
class Model:
    """low, high: bounds of each measure; knots: (measures, KNOTS) hinges; middle, scale: of the features; weights; threshold and spread: of the scores."""

    low: np.ndarray
    high: np.ndarray
    knots: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    spread: float = 1.0

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        hinges = np.maximum(x[:, :, None] - self.knots[None], 0).reshape(len(x), -1)
        return (np.column_stack([x, hinges]) - self.middle) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of rows of measures."""
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -500, 500)))


def pairs(good: int, bad: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a good and of a bad text for each preference pair: each text of the larger class meets `rounds` others, none twice."""
    n = max(good, bad)
    at = np.concatenate([np.arange(n)] * min(rounds, good, bad))
    turn = np.repeat(np.arange(min(rounds, good, bad)), n)
    return (at, (at + turn) % bad) if good >= bad else ((at + turn) % good, at)


def slopes(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The number of the rows of differences (preferred less other), and the sums of their losses' slopes and curvatures, one after the other."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance of the other order
    return np.concatenate([[len(d)], -(d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def descended(sums: Callable[[np.ndarray], np.ndarray], n: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the mean logistic loss, by Newton steps. sums: of `slopes` over all rows at given weights."""
    w = np.zeros(n)
    for _ in range(60):
        s = sums(w)
        count = max(s[0], 1)
        step = np.linalg.solve(s[n + 1 :].reshape(n, n) / count + ridge * np.eye(n), s[1 : n + 1] / count + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fitted(d: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the mean logistic loss of the rows of differences (preferred less other)."""
    return descended(lambda w: slopes(d, w), d.shape[1], ridge)


def quantile(scores: np.ndarray, weight: np.ndarray, share: float) -> float:
    """A value below which `share` of the weight lies: the middle between the two neighbouring distinct scores whose cut comes nearest."""
    values, at = np.unique(scores, return_inverse=True)
    below = np.cumsum(np.bincount(at, weight, len(values))) / weight.sum()
    if len(values) == 1:
        return float(values[0])
    k = int(np.abs(below[:-1] - share).argmin())
    return float((values[k] + values[k + 1]) / 2)


def keys(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of doubles; -0.0 as 0.0."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def unkeyed(k: int) -> float:
    return float(np.array([k ^ (1 << 63) if k >> 63 else k ^ (2**64 - 1)], np.uint64).view(np.float64)[0])


def by_byte(key: np.ndarray, prefix: int, level: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Of the keys whose first `level` bytes are the prefix, the weight of each next byte."""
    same = key >> np.uint64(64 - 8 * level) == np.uint64(prefix) if level else np.ones(len(key), bool)
    byte = (key[same] >> np.uint64(56 - 8 * level)) & np.uint64(255)
    return np.bincount(byte.astype(int), None if weight is None else weight[same], 256).astype(float)


def ranked(sums: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray], columns: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray | None]]], wanted: list[float]) -> list[float]:
    """Of each of several columns of weighted values the least one up to which the weight is more than `wanted`, or the greatest; exactly, by eight passes of counting. sums: of a function over the tables (measures, qualities) of all tasks."""
    prefix, below = [0] * len(wanted), [0.0] * len(wanted)
    for level in range(8):
        counts = sums(lambda x, y: np.concatenate([by_byte(keys(v), p, level, w) for (v, w), p in zip(columns(x, y), prefix, strict=True)])).reshape(-1, 256)  # noqa: B023
        for t, c in enumerate(counts):
            up = below[t] + np.cumsum(c)
            byte = int(np.argmax(up > wanted[t])) if (up > wanted[t]).any() else int(np.flatnonzero(c)[-1])
            below[t] = float(up[byte] - c[byte])
            prefix[t] = prefix[t] * 256 + byte
    return [unkeyed(p) for p in prefix]


def quantiles(sums, column: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], counts: list[float], shares: tuple[float, ...]) -> np.ndarray:
    """(columns, shares): quantiles of columns of so many values each, interpolated as numpy does."""
    at = [(c, (n - 1) * q) for c, n in enumerate(counts) for q in shares]
    places = [(c, min(np.floor(p) + k, counts[c] - 1)) for c, p in at for k in (0, 1)]
    found = ranked(sums, lambda x, y: [(column(x, y)[c], None) for c, _ in places], [r for _, r in places])
    return np.array([a + (p - np.floor(p)) * (b - a) for (_, p), a, b in zip(at, found[::2], found[1::2], strict=True)]).reshape(len(counts), -1)


def cut_at(sums, values: Callable[[np.ndarray], np.ndarray], weights: tuple[float, float], total: float, share: float) -> float:
    """As `quantile`, of values in tasks; weights: of a text of quality 0 and 1; total: of all."""
    weight = lambda y: np.where(y == 1, weights[1], weights[0])
    v = ranked(sums, lambda x, y: [(values(x), weight(y))], [share * total * (1 - 1e-12)])[0]

    def around(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s, w = values(x) + 0.0, weight(y)
        return np.array([w[s < v].sum(), w[s == v].sum()])

    under, here = sums(around) / total
    # the neighbours: the greatest value below and the least above, by their weights
    u = ranked(sums, lambda x, y: [(values(x)[values(x) + 0.0 < v], weight(y)[values(x) + 0.0 < v])], [under * total])[0] if under > 0 else None
    above = 1 - under - here > 1e-12
    if u is None and not above:
        return v
    if u is not None and (not above or abs(under - share) <= abs(under + here - share)):
        return (u + v) / 2
    w = ranked(sums, lambda x, y: [(values(x)[values(x) + 0.0 > v], weight(y)[values(x) + 0.0 > v])], [0.0])[0]
    return (v + w) / 2


def summed(data: DataFrame, f: Callable[..., np.ndarray], *columns: str) -> np.ndarray:
    """The sum of f over the tables of all tasks; one row of sums a task reaches the driver. Columns of arrays of measures are matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            of = [np.asarray(c.flatten(), float).reshape(-1, len(MEASURES)) if pa.types.is_list(c.type) else np.asarray(c) for c in (b.column(n) for n in columns)]
            if b.num_rows:
                part = f(*of)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    return np.sum([r["s"] for r in data.select(*columns).mapInArrow(run, "s array<double>").collect()], axis=0)


def learned(chosen: DataFrame, met: DataFrame, bad_share: float, good: int, bad: int) -> Model:
    """The model of texts (quality, x) with so many of either quality; met: buckets of their measures (good, bad) as arrays; bad_share: of quality 0 among all labels."""
    sums = lambda f: summed(chosen, f, "x", "quality")
    n, m = good + bad, len(MEASURES)
    q = quantiles(sums, lambda x, y: list(np.ascontiguousarray(x.T)), [n] * m, (0.005, *KNOTS, 0.995))
    model = Model(q[:, 0], q[:, -1], q[:, 1:-1], np.zeros(1), np.ones(1), np.zeros(1))
    middle = sums(lambda x, y: model.features(x).sum(0)) / n
    scale = np.sqrt(sums(lambda x, y: ((model.features(x) - middle) ** 2).sum(0)) / n)
    model.middle, model.scale = middle, np.where(scale < 1e-9, 1.0, scale + 1e-9)

    def pair_sums(w: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        def f(g: np.ndarray, h: np.ndarray, many: np.ndarray, few: np.ndarray) -> np.ndarray:
            total, a, b = np.zeros(1 + len(w) + len(w) ** 2), 0, 0
            for i, j in zip(many, few, strict=True):
                p, o = model.features(g[a : a + i]), model.features(h[b : b + j])
                if i and j:
                    left, right = pairs(i, j)
                    for k in range(0, len(left), 20_000):
                        total += slopes(p[left[k : k + 20_000]] - o[right[k : k + 20_000]], w)
                a, b = a + i, b + j
            return total

        return f

    model.weights = descended(lambda w: summed(met, pair_sums(w), "good", "bad", "n_good", "n_bad"), len(middle))
    # distinct texts have their own share of bad ones; the quantile speaks of the share in all labels
    weights = bad_share * n / bad, (1 - bad_share) * n / good
    model.threshold = cut_at(sums, model.raw, weights, float(n), bad_share)
    between = quantiles(sums, lambda x, y: [model.raw(x)[y == 0], model.raw(x)[y == 1]], [bad, good], (0.5,))
    model.spread = max(SPREAD * float(between[1, 0] - between[0, 0]), 1e-6)
    return model


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD


def measured(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, and the measures of each whole text as `x`."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([measures(t).tolist() for t in texts(b.column("text"))], pa.list_(pa.float64()))], names=[*keep, "x"])

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(rows.select(*keep, "text"), f, f"{types}, x array<double>")


def bucketed(chosen: DataFrame, good: int, bad: int, size: int = BUCKET, few: int = FEW) -> DataFrame:
    """(good, bad, n_good, n_bad): texts (quality, x) dealt to buckets, as arrays of all their measures. The larger class tells how many there are; a text of the smaller one stands in as many as it takes for each to have a few."""
    buckets = max(1, -(-max(good, bad) // size))
    times = min(buckets, max(1, -(-few * buckets // min(good, bad))))
    at = F.pmod(F.xxhash64("x"), F.lit(buckets))
    copies = F.when(F.col("quality") == int(good < bad), times).otherwise(1)
    each = chosen.select("quality", "x", F.explode(F.sequence(at, at + copies - 1)).alias("b")).withColumn("b", F.pmod("b", F.lit(buckets)))
    of = lambda c: F.flatten(F.sort_array(F.collect_list(F.when(F.col("quality") == c, F.col("x")))))
    out = each.groupBy("b").agg(of(1).alias("good"), of(0).alias("bad"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("quality") == 0).alias("n_bad"))
    return settled(out.drop("b"))


def trained(docs: DataFrame, labels: DataFrame, sent: int = SENT) -> Model | None:
    """The model, from all labelled texts whose fold isn't held out; None without both classes. What reaches the driver are sums, one row a task."""
    known = settled(labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(share) < 2:
        return None
    if share[0] + share[1] <= sent:
        found = measured(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), ("quality",))
    else:  # no text is shuffled
        found = measured(docs.select("doc_id", "text").where(~held_out()), ("doc_id",)).join(known, "doc_id").select("quality", "x")
    # one row for each distinct text, so that copies don't count twice
    chosen = settled(found.distinct())
    n = {r["quality"]: r["count"] for r in chosen.groupBy("quality").count().collect()}
    if len(n) < 2:
        return None
    return learned(chosen, bucketed(chosen, n[1], n[0]), share[0] / (share[0] + share[1]), n[1], n[0])


def scored(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns, and as `name` the score of each whole text between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        m, found = shared.value, texts(b.column("text"))
        s = np.ones(len(found)) if m is None else m.score(np.array([measures(t) for t in found]).reshape(-1, len(MEASURES)))
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s)], names=[*keep, name])

    kept = docs.select(*dict.fromkeys((*keep, "text")))
    types = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(kept, f, f"{types}, `{name}` double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = scored(docs, trained(docs, labels))
    return s.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores below the threshold; columns and other rows stay as they are."""
    names = docs.columns
    mark = fresh(names, "__quality")
    return scored(docs, trained(docs, labels), tuple(names), mark).where(F.col(mark) >= threshold).select(*names)
