"""Exact n-gram Jaccard join: rare shared shingles, star comparisons, then signature trees.

1. Every text becomes the set of hashes of its five-word shingles; equal sets are one set.
2. A set can only link if three quarters of its shingles occur in other sets. Shingles meet
   by hash and each set's shared ones are counted; few sets remain.
3. Among these, shingles are ordered by the number of sets that hold them. Two sets that
   link share one of the first quarter of their shingles in this order (prefix filter), and
   their sizes lie in the same band or in two that adjoin. So a group is a shingle and a
   band, with the sets of this band and of the next.
4. In each group the set with the least of its own shingles (in a family of near copies: what
   they were copied from) is the centre, and every other is compared with it. What links is
   one class from here on, so large families of copies are done with.
5. Groups that still hold several classes are searched by signature trees: nodes hold the OR
   of their sets' bitmaps and the range of their sizes. A dual traversal drops node pairs
   whose largest possible overlap is too small or that are one class, and compares the rest
   exactly, until all is connected. Groups that share sets are searched together as long as
   one task can hold them; else each for itself, and one too large in pairs of blocks.

Cases: null and empty texts have no shingles and link with nothing; a text of one to four
words is one shingle; repeated rows are linked; rows that share a doc_id but not a text are
judged by text; a null doc_id takes part, and is the component id only where no other is;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import fresh, in_arrow, is_small, mix64, partitions, settled, slices, utf8
from belltower.llm.graph import components

SIZE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that a task holds of what it searches: beyond, groups are searched singly, and one group in pairs of blocks.
BLOCK_TOKENS = 1_000_000
#: Rows of one or two numbers are broadcast up to so many.
MAX_BROADCAST = 500_000
#: Comparisons with one centre that go to one task.
PER_CENTRE = 250
LEAF, FAN, BITMAP = 64, 8, 16
#: Shingles that a task gathers before it sends them off; parts that a partition's shingles are counted in.
CHUNK, FINER = 500_000, 4

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """Powers of the polynomial's base and of its inverse: up to KEPT they are remembered, longer tables go with the text that needed them."""

    KEPT = 1 << 17

    def __init__(self):
        self.up, self.down = self.made(1)

    def made(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(_INVERSE))
        up[0] = down[0] = 1
        return np.cumprod(up, out=up), np.cumprod(down, out=down)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return self.made(n)
        if n > len(self.up):
            self.up, self.down = self.made(min(max(n, 2 * len(self.up), 4096), self.KEPT))
        return self.up, self.down


_POWERS = Powers()


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: words lower-cased, joined by a space, hashed by differences of one running polynomial."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    up, down = _POWERS.upto(len(line) + 1)
    total = np.zeros(len(line) + 1, np.uint64)
    raw = np.frombuffer(line, np.uint8)
    np.cumsum(_BYTES[raw] * up[: len(line)], out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(line))
    n = min(size, len(words))
    starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    return np.unique(mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))


def set_key(s: np.ndarray) -> int:
    """One number for a set: equal for equal sets."""
    return int(mix64(np.array([mix64(s + np.uint64(77)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def row_key() -> Column:
    """Tells a row by what the join reads of it: rows of the same key are the same."""
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row key, number of shingles and set key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                found = [(len(s), set_key(s)) for s in map(shingles, utf8(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())], names=["doc_id", "row", "n", "key"])

    return in_arrow(docs.select("doc_id", "text", row_key().alias("row")), run, "doc_id long, row long, n long, key long")


def shared_counts(docs: DataFrame) -> DataFrame:
    """(key, shared): how many of a set's shingles occur in other sets too (or a few more: hashes are cut to 32 bits here, and a set in several tasks may count a shingle twice).

    A task gathers shingles of distinct sets and tells those that it holds twice, whose sets
    it counts at once; of these it sends one each, so that a common shingle is no hot key.
    The others go with their sets' keys, packed by bucket. What the buckets say of the sets
    goes on packed by set, and is added there.
    """
    width = partitions(docs.sparkSession)
    buckets = width * FINER

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, int] = {}
        sets: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
            bucket = ((every >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            token = every.astype(np.uint32)
            del every
            order = np.lexsort((token, bucket))
            bucket, token, owner = bucket[order], token[order], owner[order]
            del order
            first = np.append(True, (bucket[1:] != bucket[:-1]) | (token[1:] != token[:-1]))
            alone = first & np.append(first[1:], True)
            names = np.fromiter(keys, np.int64, len(keys))
            here = np.bincount(owner[~alone], minlength=len(names))
            pack = names.view(np.uint64) % np.uint64(buckets)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                cut = slice(edges[k], edges[k + 1])
                single = alone[cut]
                many = token[cut][first[cut] & ~single]
                sorted_owner = np.argsort(owner[cut][single], kind="stable")
                who, n = np.unique(owner[cut][single], return_counts=True)
                mine = np.flatnonzero((pack == k) & (here > 0))
                if len(who) or len(many) or len(mine):
                    rows.append((k, names[who].tobytes(), n.astype(np.uint32).tobytes(), token[cut][single][sorted_owner].tobytes(), many.tobytes(), names[mine].tobytes(), here[mine].astype(np.int64).tobytes()))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "counts", "tokens", "many", "own", "here"])

        for b in batches:
            for part in slices(b):
                for t in utf8(part.column("text")):
                    s = shingles(t)
                    if len(s) and (k := set_key(s)) not in keys:
                        keys[k] = len(s)
                        sets.append(s)
                        held += len(s)
                        if held >= CHUNK:
                            yield packed()
                            keys.clear()
                            sets.clear()
                            held = 0
        if sets:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for bucket, *x in zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "counts", "tokens", "many", "own", "here")), strict=True):
                parts.setdefault(bucket, []).append(x)
        for bucket in list(parts):
            rows = parts.pop(bucket)
            keys, n, tokens, many, own, here = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in enumerate((np.int64, np.uint32, np.uint32, np.uint32, np.int64, np.int64)))
            names, owner = np.unique(keys, return_inverse=True)  # a set that several tasks hold is one
            owner = np.repeat(owner.astype(np.int32), n)
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            del order
            once = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))[: len(tokens)]
            tokens, owner = tokens[once], owner[once]
            same = tokens[1:] == tokens[:-1]
            more = np.append(False, same) | np.append(same, False) if len(tokens) else np.zeros(0, bool)
            more |= np.isin(tokens, many)
            total = np.bincount(owner[more], minlength=len(names))
            at = np.flatnonzero(total)
            names, total = np.concatenate([names[at], own]), np.concatenate([total[at], here])
            pack = names.view(np.uint64) % np.uint64(width)
            rows = [(k, names[mine].tobytes(), total[mine].astype(np.int64).tobytes()) for k in range(width) if len(mine := np.flatnonzero(pack == k))]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["pack", "keys", "shared"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(b.column("keys").to_pylist(), b.column("shared").to_pylist(), strict=True)]
        if rows:
            keys, to = np.unique(np.concatenate([np.frombuffer(k, np.int64) for k, _ in rows]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(to, np.concatenate([np.frombuffer(n, np.int64) for _, n in rows])).astype(np.int64))], names=["key", "shared"])

    dealt = in_arrow(docs.select("text"), deal, "bucket int, keys binary, counts binary, tokens binary, many binary, own binary, here binary").repartitionById(width, F.col("bucket") % width)
    packed = in_arrow(dealt, count, "pack int, keys binary, shared binary").repartitionById(width, "pack")
    return in_arrow(packed, add, "key long, shared long")


def small(df: DataFrame) -> DataFrame:
    """Rows of a few numbers, marked for broadcast if they are few enough."""
    return F.broadcast(df) if is_small(df, MAX_BROADCAST) else df


def candidate_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, n, band, tokens): the sets that can link, each once, with their shingles."""
    sets = rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min("row").alias("row"))
    wanted = settled(sets.join(shared_counts(docs), "key").where(F.col("shared") * 100 >= F.col("n") * PERCENT).select("row"))
    texts = docs.select("text", row_key().alias("row")).join(small(wanted), "row", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                sets = [shingles(t) for t in utf8(part.column("text"))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), tokens], names=["key", "n", "tokens"])

    bounds = [1]
    while bounds[-1] < 1 << 30:  # two sizes of which one is at most 4/3 of the other are in one band or in two that adjoin
        bounds.append(100 * bounds[-1] // PERCENT + 1)
    made = in_arrow(texts, run, "key long, n long, tokens array<long>").dropDuplicates(["key"])
    return settled(made.select("key", "n", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("n"))).alias("band"), "tokens"))


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, key, n, band, alone): of every set the shingles of which a set that links with it must share one. alone: the set's shingles that no other candidate holds."""
    each = sets.select("key", "n", "band", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    both = each.join(held, "token")
    # a prefix is n - ceil(0.75 n) + 1 shingles; the ones that no other set holds come first and link nothing
    ranked = both.withColumn("alone", F.expr("n - count(*) OVER (PARTITION BY key)")).withColumn("rank", F.expr("row_number() OVER (PARTITION BY key ORDER BY times, token)") + F.col("alone"))
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("token", "key", "n", "band", "alone")


def grouped(sets: DataFrame) -> DataFrame:
    """(token, band, key, n, side, centre): the groups, of those with the same members only one. Side 1: a set of the next band."""
    places = F.explode(F.array(F.struct("band", F.lit(0).alias("side")), F.struct((F.col("band") - 1).alias("band"), F.lit(1).alias("side"))))
    members = settled(prefixes(sets).withColumn("p", places).select("token", "p.band", "key", "n", "p.side", "alone"))
    mark = lambda salt: F.xxhash64("key", "side", F.lit(salt))
    told = members.groupBy("token", "band").agg(
        F.min(F.when(F.col("side") == 0, F.struct((F.col("alone") / F.col("n")).alias("share"), "key"))).alias("c"), F.count("*").alias("members"), F.bit_xor(mark(0)).alias("x"), F.sum(mark(1).cast("decimal(38,0)")).alias("y"),
    )
    told = told.where("members > 1 AND c IS NOT NULL").groupBy("members", "x", "y").agg(F.min(F.struct("token", "band")).alias("g"), F.min("c.key").alias("centre"))
    return settled(members.join(told.select("g.token", "g.band", "centre"), ["token", "band"]).select("token", "band", "key", "n", "side", "centre"))


def star_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the members of a group and its centre a. A centre of very many members is dealt to several tasks."""
    pairs = settled(groups.where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct())
    hot = small(settled(pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_CENTRE).cast("int").alias("parts")).where("parts > 1")))
    parts = F.coalesce("parts", F.lit(1))
    asked = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    centres = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(pairs.select("a").distinct(), "a", "left_semi").join(hot, "a", "left")
    centres = centres.select("a", "na", "ta", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint"))).alias("part"))
    both = asked.join(sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b").join(centres, ["a", "part"])
    like = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    linked = F.size(F.array_intersect("ta", "tb")) * (100 + PERCENT) >= PERCENT * (F.col("na") + F.col("nb"))
    return both.where(F.when(like, linked).otherwise(False)).select("a", "b")


class Forest:
    """Disjoint sets of rows; rows of equal class begin as one."""

    def __init__(self, classes: np.ndarray):
        _, first, to = np.unique(classes, return_index=True, return_inverse=True)
        self.up = first[to]

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[at] = r
        return r


class SignatureTree:
    """Levels of nodes over sets; every node has the OR of its bitmaps, least and greatest size, and the most shingles that share a bit with another.

    Sets of like sizes, and there sets of one class, lie side by side, so that ORs of nodes fill up little.
    """

    def __init__(self, sets: list[np.ndarray], ids: np.ndarray, classes: np.ndarray):
        n = np.array([len(s) for s in sets])
        low = np.array([s[0] for s in sets])
        order = np.lexsort((low, classes, np.floor(np.log(n) / np.log(4 / 3))))
        self.sets, self.ids, self.n = [sets[i] for i in order], ids[order], n[order]
        self.bits = np.zeros((len(sets), BITMAP), np.uint64)
        for i, s in enumerate(self.sets):
            b = s % np.uint64(BITMAP * 64)
            np.bitwise_or.at(self.bits[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        over = self.n - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.rows = (self.bits, self.n, self.n, over)
        self.levels = []
        level, step = self.rows, LEAF
        while True:
            at = np.arange(0, len(level[1]), step)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)
            step = FAN
            if len(at) == 1:
                break


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Whether the largest possible overlap of nodes a[i] and b[j] reaches what the least sizes need."""
    most = np.bitwise_count(a[0][i] & b[0][j]).sum(1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
    most = np.minimum(most, np.minimum(a[2][i], b[2][j]))
    return most * (100 + PERCENT) >= PERCENT * (a[1][i] + b[1][j])


def tree_links(a: SignatureTree, b: SignatureTree | None, forest: Forest) -> Iterator[tuple[int, int]]:
    """Links between (or, without b, within) trees that connect what the forest has apart, as row ids."""
    own = b is None
    b = a if b is None else b
    depth = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        la, lb = a.levels[min(d, len(a.levels) - 1)], b.levels[min(d, len(b.levels) - 1)]
        if d < depth:  # children of the pairs that are left
            fa, fb = FAN if d < len(a.levels) - 1 else 1, FAN if d < len(b.levels) - 1 else 1
            i = (i[:, None, None] * fa + np.arange(fa)[None, :, None] + np.zeros(fb, np.int64)).ravel() if fa > 1 else np.repeat(i, fb)
            j = (j[:, None, None] * fb + np.zeros(fa, np.int64)[None, :, None] + np.arange(fb)).ravel() if fb > 1 else np.repeat(j, fa)
            ok = (i < len(la[1])) & (j < len(lb[1])) & ((i <= j) if own else True)
            i, j = i[ok], j[ok]
        ok = may_link(la, i, lb, j)
        i, j = i[ok], j[ok]
    for x, y in zip(i, j, strict=True):
        p = np.arange(x * LEAF, min((x + 1) * LEAF, len(a.n)))
        q = np.arange(y * LEAF, min((y + 1) * LEAF, len(b.n)))
        if len(np.unique(np.concatenate([forest.roots(a.ids[p]), forest.roots(b.ids[q])]))) == 1:
            continue
        u, v = np.repeat(p, len(q)), np.tile(q, len(p))
        ok = may_link(a.rows, u, b.rows, v) & ((u < v) if own else True)
        u, v = u[ok], v[ok]
        if not len(u):
            continue
        overlap = common(a, p, b, q)[u - p[0], v - q[0]]
        ok = overlap * (100 + PERCENT) >= PERCENT * (a.n[u] + b.n[v])
        for s, t in zip(a.ids[u[ok]], b.ids[v[ok]], strict=True):
            r, w = forest.root(s), forest.root(t)
            if r != w:
                forest.up[max(r, w)] = min(r, w)
                yield int(s), int(t)


def common(a: SignatureTree, p: np.ndarray, b: SignatureTree, q: np.ndarray) -> np.ndarray:
    """Exact overlaps of the sets p of a and q of b, in slices of shingles."""
    x, y = [a.sets[k] for k in p], [b.sets[k] for k in q]
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(p), len(q)), np.int64)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]

        def grid(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            g = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                place = np.searchsorted(part, s)
                g[k, place[part[np.minimum(place, len(part) - 1)] == s]] = 1
            return g

        out += np.rint(grid(x) @ grid(y).T).astype(np.int64)
    return out


def group_links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
    """Links of one group that connect what its classes leave apart: within a block (all of side 0), or between two blocks."""
    if not len(keys) or (classes == classes[0]).all():
        return []
    forest = Forest(classes)
    trees = [SignatureTree([sets[i] for i in at], at, classes[at]) for s in (0, 1) if len(at := np.flatnonzero(side == s))]
    if len(trees) == 2:
        found = tree_links(trees[0], trees[1], forest)
    else:
        found = tree_links(trees[0], None, forest) if not side.any() else iter(())
    return [(int(keys[a]), int(keys[b])) for a, b in found]


def open_groups(groups: DataFrame, stars: DataFrame) -> DataFrame:
    """(token, band, key, n, class) of the groups that hold several classes, but for a pair that was compared as centre and member."""
    joined = groups.join(stars.select(F.col("node").alias("key"), F.col("component").alias("class")), "key", "left").withColumn("class", F.coalesce("class", "key"))
    joined = settled(joined)
    several = joined.groupBy("token", "band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("members")).where("low <> high AND members > 2")
    return settled(joined.join(several.select("token", "band", "low"), ["token", "band"]).select("token", "band", "low", "key", "n", "class"))


def tree_searches(left: DataFrame) -> DataFrame:
    """(search, i, j, side, key, class): what is searched together: all groups that hang together by their classes where a task can hold them, else one group, else a pair of its blocks."""
    hang = components(left.select(F.col("low").alias("a"), F.col("class").alias("b")).distinct())
    named = left.join(hang.select(F.col("node").alias("class"), "component"), "class")
    # each set once for its cluster
    once = settled(named.groupBy("component", "key").agg(F.first("n").alias("n"), F.first("class").alias("class")))
    fits = settled(once.groupBy("component").agg(F.sum("n").alias("tokens")).select("component", (F.col("tokens") <= BLOCK_TOKENS).alias("fits")))
    none = F.lit(0)
    together = once.join(fits.where("fits"), "component").select(F.xxhash64("component").alias("search"), none.alias("i"), none.alias("j"), none.alias("side"), "key", "class")
    single = named.join(fits.where("NOT fits"), "component").select(F.xxhash64("token", "band").alias("search"), "key", "n", "class")
    blocks = single.groupBy("search").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    single = single.join(blocks, "search").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # a pair of blocks (i, j) gets the rows of both; (i, i) those of one
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    single = single.withColumn("p", pair).select("search", "p.i", "p.j", (F.col("own") != F.col("p.i")).cast("int").alias("side"), "key", "class")
    return settled(together.unionByName(single))


def links(sets: DataFrame, searches: DataFrame) -> DataFrame:
    """(a, b): links that connect what any links connect, within the searches."""
    dealt = searches.join(sets.select("key", "tokens"), "key").repartition(partitions(sets.sparkSession), "search", "i", "j").sortWithinPartitions("search", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets, side, classes = None, [], [], [], []

        def solved() -> pa.RecordBatch | None:
            found = group_links(np.array(keys, np.int64), sets, np.array(side), np.array(classes, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]) if found else None

        for b in batches:
            column = b.column("tokens")
            ends, every = np.asarray(column.offsets), np.asarray(column.values)
            for r, (search, i, j, s, k, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("search", "i", "j", "side", "key", "class")), strict=True)):
                if (search, i, j) != now:
                    if (out := solved()) is not None:
                        yield out
                    now, keys, sets, side, classes = (search, i, j), [], [], [], []
                keys.append(k)
                sets.append(every[ends[r] : ends[r + 1]].view(np.uint64).copy())
                side.append(s)
                classes.append(c)
        if (out := solved()) is not None:
            yield out

    return in_arrow(dealt, run, "a long, b long")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, component_id, and the row key that stands for the component (null without shingles) of every row."""
    rows = settled(keyed(docs))
    sets = candidate_sets(docs, rows)
    groups = grouped(sets)
    stars = settled(star_links(groups, sets))
    left = open_groups(groups, components(stars))
    found = components(stars.unionByName(settled(links(sets, tree_searches(left)))))
    labelled = settled(rows.where("n > 0").join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("doc_id", "row", "n", F.coalesce("component", "key").alias("label")))
    # written first, so that both sides of the join are plain shuffles and a label of very many rows can be split
    least = settled(labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("l")).select("label", F.col("l.doc_id").alias("component_id"), F.col("l.row").alias("lead")))
    full = labelled.join(least, "label").select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", "lead")
    return full.unionByName(rows.where("n = 0").select("doc_id", "row", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("lead")))


def query(docs: DataFrame) -> DataFrame:
    return joined(docs).drop("row", "lead")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked texts: that of the least doc_id; texts without words all stay."""
    names = docs.columns
    mark = fresh(names, "__row")
    rows = settled(joined(docs).where("lead IS NOT NULL").groupBy(F.col("row").alias(mark)).agg(F.count("*").alias("times"), F.first(F.col("row") == F.col("lead")).alias("leads")))
    # few rows go, and few are repeated as they are
    gone = small(settled(rows.where("NOT leads OR times > 1").select(mark)))
    repeated = small(settled(rows.where("leads AND times > 1").select(mark)))
    d = docs.withColumn(mark, row_key())
    return d.join(gone, mark, "left_anti").unionByName(d.join(repeated, mark, "left_semi").dropDuplicates([mark])).select(*names)
