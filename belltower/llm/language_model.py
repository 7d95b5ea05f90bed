"""A gated recurrent language model with a class-factored output, and exact corpus counts.

The network is trained in numpy by truncated backpropagation on every token of all training
texts: they are dealt to TURNS turns and in each to shards of about SHARD_TEXTS; every
shard's texts are gone through once from the turn's weights, and the mean of the shards'
weights by their tokens is what the next turn starts from. Everything counted comes from all
training texts. Its symbols are their most frequent words, an end, and kinds of rarer words by
their form; a rarer word's probability is its kind's times its share of that kind in the
corpus counts, so every word sequence has a probability and they sum to one. Texts are
scored whole: windows of steps, with the state carried from window to window.

Texts are split twice: for the list of frequent words, and to be stored as codes of their
words, which counting, training and scoring read. Counting: words outside a bounded list of
frequent ones go as (word hash, row, times), packed, through one shuffle by word hash; each
task adds up its words and sends back its sums for the rows, packed by row hash, and a second
shuffle adds these. Frequent words are summed inside the tasks first, so that none is a hot
key. Their list comes from bounded summaries of all training texts, one for each task, that
are added up: every word of more than one in FREQUENT tokens is in it, and with it every word
that can have a symbol in such a corpus.

Cases: a null or empty text is one end token; a null doc_id is a training text; repeated
rows count each and get equal results; an empty table gives an empty result; ties in
frequency go by the word's bytes; other columns are not read.
"""

from __future__ import annotations

import ctypes
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import partitions, settled, slices

#: Words with a symbol of their own; words counted inside the tasks, which is also what a task's summary of words holds at least.
VOCABULARY, FREQUENT = 2000, 60_000
HIDDEN, CLASSES = 24, 40
STREAMS, STEPS = 256, 32
#: Turns of the training over all texts, about how many texts a shard has, and the first turn's rate.
TURNS, SHARD_TEXTS, RATE = 6, 1500, 0.02
#: Parts in which weights are added up.
PARTS = 8
FOLDS, HELD = 7, 2
#: Tokens that a task scores together.
CHUNK = 1_500_000
#: Texts whose steps are taken together, and about how many tokens of theirs before their probabilities are looked up.
TOGETHER, WINDOW = 512, 8192
#: Beyond this, numbers are lessened by their largest before they become exponents.
LARGE = 60.0
#: A row's sums over its rarer words, as they are packed.
SUMS = np.dtype([("row", np.int64), ("total", np.float64), ("known", np.int64)])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def kind_of(word: bytes) -> int:
    """Kind of a rare word: first letter beyond ASCII, closing sign, length."""
    n, beyond = len(word), 0
    if not word.isascii() and (m := _BEYOND(word)).start() + 1 < n:
        beyond = 1 + word[m.start() + 1] % 7
    last = word[-1] if n else 0
    return beyond * 9 + (3 if last == 46 else 6 if last == 44 else 0) + (0 if n < 6 else 1 if n < 10 else 2)


_BEYOND = re.compile(rb"[\x80-\xff]").search
KINDS = 72
#: Code of a text's end; codes from FREQUENT on are kinds.
END = FREQUENT + KINDS


def kinds_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Kinds of the words that begin and end at these places of the bytes."""
    start, end, n = at[:-1], at[1:], np.diff(at)
    high = np.append(np.flatnonzero(raw & 128), len(raw))
    after = high[np.searchsorted(high, start)] + 1
    raw = np.append(raw, np.uint8(0))
    beyond = np.where(after < end, 1 + raw[np.minimum(after, len(raw) - 1)] % 7, 0)
    last = np.where(n > 0, raw[end - 1], 0)
    return beyond * 9 + np.where(last == 46, 3, np.where(last == 44, 6, 0)) + np.where(n < 6, 0, np.where(n < 10, 1, 2))


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts' distinct words, the numbers in them of all their words, and the text each is of; null has none."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    coded = parts.flatten().dictionary_encode()
    words, ids = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())
    # white space at a text's ends leaves an empty part
    if (empty := pc.index(words, b"").as_py()) >= 0:
        words, kept = pa.concat_arrays([words[:empty], words[empty + 1 :]]), ids != empty
        ids, owner = ids[kept] - (ids[kept] > empty), owner[kept]
    return words, ids, owner


def keys_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of words that hold a word's kind in their last bits, and the kinds."""
    _, at, raw = words.buffers()
    at = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = raw.to_pybytes()[at[0] : at[-1]] if raw is not None else b""
    at -= at[0]
    ends = at.tolist()
    kinds = kinds_of(np.frombuffer(data, np.uint8), at)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(ends, ends[1:], strict=False)), np.uint64, len(words))
    return keys & ~np.uint64(127) | kinds.astype(np.uint64), kinds


@dataclass
class Network:
    words: dict[bytes, int]  # symbol of each word with its own
    kinds: np.ndarray  # symbol of each kind
    end: int
    bounds: np.ndarray  # symbols of class c are bounds[c] to bounds[c + 1]
    p: dict[str, np.ndarray]  # x: (V, 3H) input; u: (H, 3H) recurrence; c, bc: classes; w, bw: symbols

    def class_of(self, s: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[s]


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(p: dict, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One gated step from state h and input rows x: the update gates, reset gates and candidate; fastest where h lies column by column."""
    n = h.shape[1]
    g = p["u"][:, : 2 * n].T @ h.T
    g += x.T[: 2 * n]
    z, r = sigmoid(g)[:n], g[n:]
    c = p["u"][:, 2 * n :].T @ (r * h.T)
    c += x.T[2 * n :]
    return z.T, r.T, np.tanh(c, out=c).T


def log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


def one_thread() -> None:
    """Products of small matrices are fastest on one thread, and an executor's other cores have tasks of their own."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("libscipy_openblas*"):
        if found := getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None):
            found(1)


def trained(samples: list[list[bytes]], rounds: int = 8, seed: int = 1) -> Network:
    """A network of the word lists' own counts, which has gone through them so many times."""
    counts = Counter(w for s in samples for w in s)
    top = sorted(counts, key=lambda w: (-counts[w], w))[:VOCABULARY]
    listed = set(top)
    rare = np.bincount([kind_of(w) for w, n in counts.items() if w not in listed for _ in range(n)] or [0], minlength=KINDS)
    net = initial({w: counts[w] for w in top}, rare, len(samples), seed)
    stream = np.array([x for s in samples for x in [*(net.words.get(w, net.kinds[kind_of(w)]) for w in s), net.end]], np.int64)
    for k in range(rounds):
        net.p = learned(net, stream, RATE * (1 - 0.9 * k / rounds))
    return net


def initial(counts: dict[bytes, int], rare: np.ndarray, texts: int, seed: int = 1) -> Network:
    """A network before its training: words with a symbol of their own and their counts, counts of the other words by kind, number of texts."""
    rng = np.random.default_rng(seed)
    top = list(counts)
    size = len(top) + KINDS + 1
    # symbols by frequency, cut into classes of equal root-frequency
    names: list[tuple[float, object]] = [(counts[w], w) for w in top] + [(max(rare[k], 1), k) for k in range(KINDS)] + [(max(texts, 1), None)]
    names.sort(key=lambda x: (-x[0], str(x[1])))
    weight = np.cumsum(np.sqrt([n for n, _ in names]))
    cut = np.searchsorted(weight, weight[-1] * np.arange(1, CLASSES) / CLASSES)
    bounds = np.unique(np.concatenate([[0], cut, [size]]))
    words = {x: i for i, (_, x) in enumerate(names) if isinstance(x, bytes)}
    kinds = np.zeros(KINDS, np.int64)
    end = 0
    for i, (_, x) in enumerate(names):
        if x is None:
            end = i
        elif not isinstance(x, bytes):
            kinds[x] = i
    h, c = HIDDEN, len(bounds) - 1
    p = {"x": rng.normal(0, 0.1, (size, 3 * h)), "u": rng.normal(0, 0.2, (h, 3 * h)), "c": rng.normal(0, 0.1, (h, c)), "bc": np.zeros(c), "w": rng.normal(0, 0.1, (h, size)), "bw": np.log(np.array([max(n, 0.5) for n, _ in names]))}
    for k in range(c):
        p["bc"][k] = np.log(np.exp(p["bw"][bounds[k] : bounds[k + 1]]).sum())
    p["bc"] -= p["bc"].mean()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return Network(words, kinds, end, bounds, p)


def improve(p: dict, grads: dict, moment: dict, turn: int, rate: float) -> None:
    """One step along clipped gradients by their running moments, in place; the gradients are used up."""
    for k, g in grads.items():
        m, v = moment[k]
        np.clip(g, -1, 1, out=g)
        m *= 0.9
        v *= 0.99
        s = g * g
        s *= 0.01
        v += s
        g *= 0.1
        m += g
        np.multiply(v, 1 / (1 - 0.99**turn), out=s)
        np.sqrt(s, out=s)
        s += 1e-6
        np.divide(m, s, out=s)
        s *= rate / (1 - 0.9**turn)
        p[k] -= s


def learned(net: Network, stream: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Weights after one pass over all of the stream, from the network's own."""
    mine = Network(net.words, net.kinds, net.end, net.bounds, {k: v.copy() for k, v in net.p.items()})
    streams = min(STREAMS, -(-len(stream) // STEPS))
    steps = -(-len(stream) // streams)
    grid = np.append(stream, np.full(streams * steps - len(stream), net.end)).reshape(streams, steps)
    # before each stream's first symbol stands the one it follows
    grid = np.concatenate([np.append(net.end, grid[:-1, -1])[:, None], grid], 1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in mine.p.items()}
    state = np.zeros((streams, HIDDEN), np.float32)
    for turn, at in enumerate(range(0, steps, STEPS), 1):
        state[grid[:, at] == net.end] = 0
        grads, state = backward(mine, grid[:, at : at + STEPS + 1][:, :-1], grid[:, at + 1 : at + STEPS + 1], state)
        improve(mine.p, grads, moment, turn, rate)
    return mine.p


@dataclass
class Outputs:
    """What states say of the symbols that follow, ordered by these symbols' classes: weights of classes and of a class's symbols that aren't normalised yet."""

    order: np.ndarray  # place of each among the given states
    states: np.ndarray  # a column for each, with a last row of ones
    every: np.ndarray  # weights of all of these
    places: np.ndarray  # (2, n): where in them the following symbol's class and it are
    logs: np.ndarray  # (2, n): logarithms of what stands there
    classes: np.ndarray  # the part for classes: a row for each class
    blocks: list[tuple[np.ndarray, slice, slice]]  # parts for symbols, a row for each; their columns and symbols
    sums: np.ndarray  # (2, n): what normalises


def outputs(net: Network, flat: np.ndarray, goal: np.ndarray) -> Outputs:
    """flat: a column for each state; goal: the symbol that follows each."""
    n, p, kind = len(goal), net.p, flat.dtype
    cls = net.class_of(goal)
    order = np.argsort(cls.astype(np.int8), kind="stable")
    goal, cls, widths = goal[order], cls[order], np.diff(net.bounds)
    counts = np.bincount(cls, minlength=len(widths))
    edges, starts = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * widths)) + len(widths) * n
    x = np.ones((len(flat) + 1, n), kind)
    np.take(flat, order, 1, out=x[:-1], mode="clip")
    c, w = np.vstack([p["c"], p["bc"]]), np.vstack([p["w"], p["bw"]])
    every = np.empty(starts[-1], kind)
    classes, blocks = every[: starts[0]].reshape(-1, n), []
    np.matmul(c.T, x, out=classes)
    for k in np.flatnonzero(counts).tolist():
        block, at, of = every[starts[k] : starts[k + 1]].reshape(widths[k], -1), slice(edges[k], edges[k + 1]), slice(net.bounds[k], net.bounds[k + 1])
        np.matmul(w[:, of].T, x[:, at], out=block)
        blocks.append((block, at, of))
    if n and max(every.max(), -every.min()) > LARGE:
        for block in (classes, *(b for b, _, _ in blocks)):
            block -= block.max(0)
    column = np.arange(n)
    places = np.stack([cls * n + column, starts[cls] + (goal - net.bounds[cls]) * counts[cls] + column - edges[cls]])
    logs, sums = every[places], np.empty((2, n), kind)
    np.exp(every, out=every)
    np.add.reduce(classes, 0, out=sums[0])
    for block, at, _ in blocks:
        np.add.reduce(block, 0, out=sums[1, at])
    return Outputs(order, x, every, places, logs, classes, blocks, sums)


def backward(net: Network, inputs: np.ndarray, targets: np.ndarray, h0: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean log-loss over one window, cut off at its start; and the state after it. A text's end resets the state.

    Arrays have a row for each unit and a column for each symbol, so that sums over units run along memory.
    """
    p, n = net.p, HIDDEN
    b, steps = inputs.shape
    ended = targets == net.end
    resets = ended.any(0).tolist()
    reads, kind = np.ascontiguousarray(inputs.T), p["u"].dtype
    flat, before, gated = np.empty((3, n, steps, b), kind)
    kept, h = [], h0
    for t in range(steps):
        z, r, c = step(p, h, p["x"].take(reads[t], 0))
        before[:, t] = h.T
        kept.append((z.T, r.T, c.T))
        np.multiply(r.T, h.T, out=gated[:, t])
        h = h - c
        h *= z
        h += c
        flat[:, t] = h.T
        if resets[t] and t + 1 < steps:
            h[ended[:, t]] = 0
    flat, goal, scale = flat.reshape(n, -1), targets.T.ravel(), 1 / targets.size
    g = {k: np.zeros_like(v) for k, v in p.items()}
    out = outputs(net, flat, goal)
    order = out.order
    # gradients of the log-loss by what the weights come from, but for each column's factor
    out.every[out.places] -= out.sums
    factors = scale / out.sums
    gc, x = (out.states * factors[0]) @ out.classes.T, out.states * factors[1]
    g["c"][:], g["bc"][:] = gc[:-1], gc[-1]
    dh, inside = p["c"] @ out.classes, np.empty_like(flat)
    for block, at, of in out.blocks:
        gw = x[:, at] @ block.T
        g["w"][:, of], g["bw"][of] = gw[:-1], gw[-1]
        np.matmul(p["w"][:, of], block, out=inside[:, at])
    dh *= factors[0]
    inside *= factors[1]
    dh += inside
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dh = dh.take(back, 1).reshape(n, steps, b)
    into = np.empty((3 * n, steps, b), kind)
    carry = np.zeros((n, b), kind)
    for t in range(steps - 1, -1, -1):
        z, r, c = kept[t]
        h, rh = before[:, t], gated[:, t]
        if resets[t] and t + 1 < steps:
            carry[:, ended[:, t]] = 0
        carry += dh[:, t]
        keep = carry * z  # what goes back along the update gate
        d = carry - keep
        drh = c * c
        np.subtract(1, drh, out=drh)
        drh *= d
        into[2 * n :, t] = drh
        drh = p["u"][:, 2 * n :] @ drh
        dz = h - c
        dz *= z
        dz *= d
        into[:n, t] = dz
        dr = 1 - r
        dr *= rh
        dr *= drh
        into[n : 2 * n, t] = dr
        drh *= r
        carry = p["u"][:, : 2 * n] @ into[: 2 * n, t]
        carry += keep
        carry += drh
    into = into.reshape(3 * n, -1)
    g["u"][:, : 2 * n] = before.reshape(n, -1) @ into[: 2 * n].T
    g["u"][:, 2 * n :] = gated.reshape(n, -1) @ into[2 * n :].T
    reads, gx = reads.ravel(), np.zeros(g["x"].T.shape, kind)
    for unit, x in zip(gx, into, strict=True):
        np.add.at(unit, reads, x)
    g["x"][:] = gx.T
    return g, flat[:, -b:].T


def log_likelihoods(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence. Texts of like length go together, longest first, so that a batch shrinks as its texts end; the state goes on from window to window."""
    out = np.zeros(len(texts))
    order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), dtype=np.int64)
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        out[some] = batch_likelihoods(net, [texts[i] for i in some])
    return out / np.log(10)


def batch_likelihoods(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each of a few symbol sequences, the longest first."""
    p, units = net.p, net.p["u"].shape[0]
    out = np.zeros(len(texts))
    sizes = np.array([len(x) for x in texts])
    h = np.zeros((len(texts), units), p["u"].dtype, "F")
    previous = np.full(len(texts), net.end)
    at = 0
    while (live := int((sizes > at).sum())) > 0:
        wide = int(min(max(WINDOW // live, 8), sizes[0] - at))
        block = np.full((wide, live), net.end)
        for r in range(live):
            x = texts[r][at : at + wide]
            block[: len(x), r] = x
        # how many texts go on at each step
        going = (live - np.searchsorted(sizes[:live][::-1], at + np.arange(wide), side="right")).tolist()
        ends = np.cumsum(going)
        flat = np.empty((units, ends[-1]), h.dtype)
        for t, (m, end) in enumerate(zip(going, ends.tolist(), strict=True)):
            if m < len(h):
                h, previous = np.asfortranarray(h[:m]), previous[:m]
            z, _, c = step(p, h, p["x"].take(previous, 0))
            h -= c
            h *= z
            h += c
            previous = block[t, :m]
            flat[:, end - m : end] = h.T
        goal = block[np.arange(live) < np.array(going)[:, None]]
        found = outputs(net, flat, goal)
        logp = (found.logs - np.log(found.sums)).sum(0, dtype=np.float64)
        owner = np.broadcast_to(np.arange(live), (wide, live))[np.arange(live) < np.array(going)[:, None]]
        out[:live] += np.bincount(owner[found.order], logp, live)
        at += wide
    return out


def lessened(n: np.ndarray, size: int) -> np.ndarray:
    """The `size` largest counts less the next one, others zero, so that a word of more than one in `size` of all tokens is never lost."""
    cut = np.partition(n, len(n) - size - 1)[len(n) - size - 1] if len(n) > size else 0
    return np.maximum(n - cut, 0)


def shortened(counts: Counter, size: int) -> Counter:
    """What is left of the most frequent words."""
    left = lessened(np.fromiter(counts.values(), np.int64, len(counts)), size).tolist()
    return Counter({w: n for w, n in zip(counts, left, strict=True) if n})


def hot_words(docs: DataFrame, size: int = FREQUENT) -> list[bytes]:
    """The frequent words of all training texts, by their counts in the tasks' summaries; ties by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> tuple[pa.Array, np.ndarray]:
            table = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            held.clear()
            return pa.concat_arrays(table.column("word").chunks), table.column("n_sum").to_numpy()

        def hold(words: pa.Array, n: np.ndarray) -> None:
            held.append(pa.table([words.filter(pa.array(n > 0)), n[n > 0]], names=["word", "n"]))

        for b in (part for whole in batches for part in slices(whole)):
            words, ids, _ = split(b.column("text"))
            if len(words):
                hold(words, np.bincount(ids, minlength=len(words)))
            if sum(t.num_rows for t in held) > 8 * size:
                words, n = summed()
                hold(words, lessened(n, 4 * size))
        if held:
            words, n = summed()
            left = shortened(Counter(dict(zip(words.to_pylist(), n.tolist(), strict=True))), size)
            yield pa.RecordBatch.from_arrays([pa.array(list(left), pa.binary()), pa.array(list(left.values()), pa.int64())], names=["word", "n"])

    counts = docs.where(~held_out()).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def fitted(encoded: DataFrame, net: Network, symbol: np.ndarray) -> Network:
    """The network after TURNS turns, which together go through every token of all training texts (turn, shard, row, codes) once. symbol: of each code."""
    spark = encoded.sparkSession
    of_code = spark.sparkContext.broadcast(symbol)
    names = sorted(net.p)
    for turn in range(TURNS):
        given, rate = spark.sparkContext.broadcast(net), RATE * (1 - 0.9 * turn / TURNS)

        def learn(batches: Iterator[pa.RecordBatch], given=given, rate=rate) -> Iterator[pa.RecordBatch]:
            one_thread()
            net, now, held, n, first = given.value, None, [], 0, None
            total = np.zeros(sum(v.size for v in net.p.values()))

            def done() -> None:
                nonlocal n
                if held:
                    stream = of_code.value[np.concatenate(held)].astype(np.int64)
                    p = learned(net, stream, rate)
                    total.__iadd__(len(stream) * np.concatenate([p[k].ravel() for k in names]).astype(np.float64))
                    n += len(stream)

            for b in batches:
                for shard, x in zip(b.column("shard").to_pylist(), b.column("codes").to_pylist(), strict=True):
                    if shard != now:
                        done()
                        now, held = shard, []
                        first = shard if first is None else first
                    held.append(np.frombuffer(x, np.uint16))
            done()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array([first] * PARTS, pa.int64()), pa.array([n] * PARTS, pa.int64()), pa.array([x.tobytes() for x in np.array_split(total, PARTS)], pa.binary())], names=["part", "first", "n", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for part, n, x in zip(*(b.column(c).to_pylist() for c in ("part", "n", "sums")), strict=True):
                    held = sums.setdefault(part, [0, 0])
                    held[0] += n
                    held[1] = held[1] + np.frombuffer(x)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["part", "n", "sums"])

        texts = encoded.where(F.col("turn") == turn).repartition(partitions(spark), "shard").sortWithinPartitions("shard", "row", "codes").select("shard", "codes")
        sums = texts.mapInArrow(learn, "part long, first long, n long, sums binary").repartition(PARTS, "part").sortWithinPartitions("part", "first").mapInArrow(add, "part long, n long, sums binary")
        parts = sorted((r["part"], r["n"], bytes(r["sums"])) for r in sums.collect())  # PARTS rows, together one set of weights
        if not parts:
            continue
        mean = np.concatenate([np.frombuffer(x) / n for _, n, x in parts]).astype(np.float32)
        ends = np.cumsum([net.p[k].size for k in names])
        net = Network(net.words, net.kinds, net.end, net.bounds, {k: x.reshape(net.p[k].shape) for k, x in zip(names, np.split(mean, ends[:-1]), strict=True)})
    return net


def encoded(docs: DataFrame, frequent: list[bytes], shards: int) -> DataFrame:
    """Every text as codes of its words (a frequent word's number; for others FREQUENT and their kind; END), with the keys of its rarer words and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ("doc_id", "row", "held_out", "turn", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        for b in (part for whole in batches for part in slices(whole)):
            n = b.num_rows
            words, ids, owner = split(b.column("text"))
            code = pc.index_in(words, known).fill_null(-1).to_numpy().astype(np.int64)
            rare, keys = code < 0, np.zeros(len(code), np.uint64)
            keys[rare], kinds = keys_of(words.filter(pa.array(rare)))
            code[rare] = FREQUENT + kinds
            codes = np.full(len(ids) + n, END, np.uint16)
            codes[np.arange(len(ids)) + owner] = code[ids]
            lacks = rare[ids]
            key, of = keys[ids[lacks]], owner[lacks]
            ends = np.cumsum(np.bincount(owner, minlength=n) + 1).tolist()
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(key))).astype(np.int32)
            key, cuts = key[first], np.searchsorted(of[first], np.arange(1, n + 1)).tolist()
            parts = [[x[i:j].tobytes() for i, j in zip([0, *to], to, strict=False)] for x, to in ((codes, ends), (key, cuts), (times, cuts))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *(pa.array(x, pa.binary()) for x in parts)], names=[*names, "codes", "keys", "times"])

    def dealt(k: int, n: int) -> F.Column:
        return F.pmod(F.xxhash64("doc_id", F.col("text"), F.lit(k)), F.lit(n)).cast("long")

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), held_out().alias("held_out"), dealt(1, TURNS).alias("turn"), dealt(2, shards).alias("shard"))
    return settled(rows.mapInArrow(run, "doc_id long, row long, held_out boolean, turn long, shard long, codes binary, keys binary, times binary"))


def counted(texts: DataFrame, listed: int) -> DataFrame:
    """What all texts, encoded, say of all words: kind 0, packed sums of rows over their rarer words; 1, a frequent word's count; 2, a word kind's totals."""
    spark = texts.sparkSession
    packs = partitions(spark)
    numbers = np.array_split(np.arange(listed), packs)  # of the frequent words counted in each pack

    def joined(b: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(name).to_pylist()), kind)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(END + 1, np.int64)
        names = ["pack", "keys", "rows", "times", "counts"]
        for b in (part for whole in batches for part in slices(whole)):
            train = ~b.column("held_out").to_numpy(zero_copy_only=False)
            sums += np.bincount(joined(b.filter(pa.array(train)), "codes", np.uint16), minlength=len(sums))
            n = np.array([len(x) // 8 for x in b.column("keys").to_pylist()])
            key, times = joined(b, "keys", np.uint64), joined(b, "times", np.int32)
            # times in texts that are held out are negative
            row, times = np.repeat(np.asarray(b.column("row")), n), np.where(np.repeat(train, n), times, -times)
            pack = (key >> np.uint64(7)) % np.uint64(packs)
            order = np.argsort(pack, kind="stable")
            found, first = np.unique(pack[order], return_index=True)
            ends = np.append(first, len(order))[1:]
            parts = [[x[i:j].tobytes() for i, j in zip(first, ends, strict=True)] for x in (key[order], row[order], times[order])]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *(pa.array(x, pa.binary()) for x in parts), pa.nulls(len(found), pa.binary())], names=names)
        if sums.any():
            none = pa.nulls(packs, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(packs), pa.int64()), none, none, none, pa.array([x.tobytes() for x in np.array_split(sums[:listed], packs)], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[str, list] = {"keys": [], "rows": [], "times": []}
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for pack, n, *x in zip(*(b.column(c).to_pylist() for c in ("pack", "counts", *packed)), strict=True):
                if n is not None:
                    counts[pack] = np.frombuffer(n, np.int64) + counts.get(pack, 0)
                else:
                    for name, part in zip(packed, x, strict=True):
                        packed[name].append(part)
        key, row, times = (np.frombuffer(b"".join(packed.pop(name)), kind) for name, kind in (("keys", np.int64), ("rows", np.int64), ("times", np.int32)))

        def rows_of(k: int, a: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int8)), pa.array(a.astype(np.int64)), pa.array(s.astype(np.float64)), pa.array(n.astype(np.int64)), pa.nulls(len(a), pa.binary())], names=["kind", "id", "total", "known", "sums"])

        if counts:
            ids, n = np.concatenate([numbers[k] for k in counts]), np.concatenate([*counts.values()])
            yield rows_of(1, ids[n > 0], n[n > 0], n[n > 0])
        if not len(key):
            return
        ids, where = np.unique(key, return_inverse=True)
        c = np.bincount(where, np.maximum(times, 0))
        times = np.abs(times)
        bucket = ids & 127
        yield rows_of(2, np.arange(KINDS), np.bincount(bucket, c, KINDS), np.bincount(bucket, c > 0, KINDS))
        # identical rows share a row key: each word of theirs counts once for it
        order = np.lexsort((row, where))
        first = np.append(True, (np.diff(where[order]) != 0) | (np.diff(row[order]) != 0))
        pick = order[first]
        owners, to = np.unique(row[pick], return_inverse=True)
        sums = np.zeros(len(owners), SUMS)
        sums["row"], sums["total"], sums["known"] = owners, np.bincount(to, times[pick] * np.log10(c[where[pick]] + 1)), np.bincount(to, times[pick] * (c[where[pick]] > 0))
        pack = owners.view(np.uint64) % np.uint64(packs)
        parts = [(k, sums[pack == k].tobytes()) for k in range(packs) if (pack == k).any()]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(parts), np.int8)), pa.array([k for k, _ in parts], pa.int64()), pa.nulls(len(parts), pa.float64()), pa.nulls(len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["kind", "id", "total", "known", "sums"])

    sent = texts.select("row", "held_out", "codes", "keys", "times").mapInArrow(emit, "pack long, keys binary, rows binary, times binary, counts binary")
    return settled(sent.repartitionById(packs, F.col("pack").cast("int")).mapInArrow(add, "kind byte, id long, total double, known long, sums binary"))


def row_sums(table: DataFrame) -> DataFrame:
    """(row, total, more): the packed sums of every row, added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, SUMS) for b in batches for x in b.column("sums").to_pylist()]
        if parts:
            every = np.concatenate(parts)
            rows, to = np.unique(every["row"], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(to, every["total"])), pa.array(np.bincount(to, every["known"]).astype(np.int64))], names=["row", "total", "more"])

    packed = table.where("kind = 0").select("id", "sums").repartitionById(partitions(table.sparkSession), F.col("id").cast("int"))
    return packed.mapInArrow(run, "row long, total double, more long")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    n_train = docs.where(~held_out()).count()
    frequent = {w: i for i, w in enumerate(hot_words(docs))}
    texts = encoded(docs, list(frequent), max(1, -(-n_train // (TURNS * SHARD_TEXTS))))
    table = counted(texts, len(frequent))
    c = np.zeros(len(frequent))
    for r in table.where("kind = 1").groupBy("id").agg(F.sum("known").alias("n")).collect():  # at most FREQUENT rows
        c[r["id"]] = r["n"]
    kinds = np.zeros((2, KINDS))
    for r in table.where("kind = 2").groupBy("id").agg(F.sum("total").alias("n"), F.sum("known").alias("v")).collect():  # KINDS rows
        kinds[:, r["id"]] = r["n"], r["v"]
    total, distinct = int(c.sum() + kinds[0].sum() + n_train), int((c > 0).sum() + kinds[1].sum() + (n_train > 0))
    # symbols go to the listed words that are most frequent in all training texts
    counts = {w: int(c[i]) for w, i in frequent.items() if c[i]}
    top = sorted(counts, key=lambda w: (-counts[w], w))[:VOCABULARY]
    listed = set(top)
    own = np.zeros(len(frequent), np.int64) - 1  # kind of a frequent word without a symbol
    for w, i in frequent.items():
        if w not in listed:
            own[i] = kind_of(w)
    kinds[0] += np.bincount(own[own >= 0], c[own >= 0], KINDS)
    kinds[1] += np.bincount(own[own >= 0], c[own >= 0] > 0, KINDS)
    net = initial({w: counts[w] for w in top}, kinds[0], n_train)
    share = np.zeros(net.p["bw"].shape[0])
    share[net.kinds] = np.log10(kinds.sum(0) + 1)
    # of each code: its symbol, log10 of its count and one, whether it occurs in training texts, and whether it is a listed word without a symbol
    symbol, logc, seen, without = np.zeros(END + 1, np.int16), np.zeros(END + 1), np.zeros(END + 1, bool), np.zeros(END + 1, bool)
    symbol[: len(frequent)] = [net.words[w] if w in listed else net.kinds[k] for w, k in zip(frequent, own, strict=True)]
    symbol[FREQUENT:END], symbol[END] = net.kinds, net.end
    logc[: len(frequent)], logc[END] = np.log10(c + 1), np.log10(n_train + 1)
    seen[: len(frequent)], seen[END] = c > 0, n_train > 0
    without[: len(frequent)] = own >= 0
    level = float(np.log10(total + distinct + 1))
    net = fitted(texts.where("NOT held_out").select("turn", "shard", "row", "codes"), net, symbol)
    given = spark.sparkContext.broadcast((net, symbol, logc, seen, logc * without - share[symbol]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        (net, symbol, logc, seen, rest), waiting, held = given.value, [], 0
        names = ("doc_id", "row", "held_out")

        def done() -> pa.RecordBatch:
            *cols, codes = zip(*waiting, strict=True)
            waiting.clear()
            length, n = np.array([len(x) for x in codes]), len(codes)
            owner, flat = np.repeat(np.arange(n), length), np.concatenate(codes)
            # sums are added up text by text, in the order of its words: equal texts get equal sums
            base, known, more = (np.bincount(owner, x[flat], n) for x in (logc, seen, rest))
            model = more + log_likelihoods(net, np.split(symbol[flat], np.cumsum(length)[:-1]))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*cols, length, known.astype(np.int64), base, model), types, strict=True)], names=[*names, "n_tokens", "known", "base", "model"])

        for b in batches:
            for *x, raw in zip(*(b.column(k).to_pylist() for k in (*names, "codes")), strict=True):
                waiting.append((*x, np.frombuffer(raw, np.uint16)))
                held += len(waiting[-1][-1])
                if held >= CHUNK:
                    yield done()
                    held = 0
        if waiting:
            yield done()

    parts = texts.select("doc_id", "row", "held_out", "codes").mapInArrow(score, "doc_id long, row long, held_out boolean, n_tokens long, known long, base double, model double")
    rest = row_sums(table)
    total_col, more = F.coalesce("total", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return parts.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + total_col - F.col("n_tokens") * level).alias("base_score"), (F.col("model") + total_col).alias("score"),
    )
