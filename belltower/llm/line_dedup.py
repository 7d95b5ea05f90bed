"""Near-duplicate lines by a segment-partition edit join.

Lines are trimmed; empty ones take no part. Equal lines are one class, and so are lines that
are within an allowance of edits, which goes by the shorter line:

* under 12 code points none, from there on 1, from 24 code points on 2 edits of code points;
* lines of 32 words and more: 2 edits of words (lines up to 33 words are compared by code
  points as well, so that no length is judged by one unit alone where two lines differ).

Lines are cut into one segment more than they have edits, of which two such lines must share
one unchanged; an index of (length, segment number, segment) is probed with the substrings
whose places fit the length difference (multi-match-aware bounds); what meets is compared by
a banded bit-parallel edit distance.

An index entry that many lines share makes no pairs of all of them: the lines of one entry
are compared within their entry and only links that connect something new are kept, and
entries too large for a task are cut into blocks whose pairs are compared.

Cases: null and empty texts have no lines; lines of any length are compared whole; repeated
rows repeat all their lines; a null doc_id is least in no class; ties go to the least doc_id
and line number; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import by_batch, fits, fresh, in_arrow, mix64, partitions, settled, slices, texts
from belltower.llm.graph import components
from belltower.llm.jaccard import Powers

#: Edits of code points by the least length that they are allowed from; edits of words, and from how many words on.
ALLOWED = ((12, 1), (24, 2))
LONG, WORD_EDITS = 32, 2
#: Lines of an index entry that one task compares; beyond, the entry is cut into blocks.
BLOCK = 1_000
MAX_BROADCAST = 24_000_000
_POWERS = Powers()
BREAK, EDGES = "\n", " \t\r\f\v"


def small(df: DataFrame, size: Column) -> DataFrame:
    """Marked for broadcast if its rows, of the given sizes in bytes, are few enough."""
    return F.broadcast(df) if fits(df, size, MAX_BROADCAST) else df


def lines_of(text: str) -> list[str]:
    return [x.strip(EDGES) for x in text.split(BREAK)]


def edit_distance_within(a: Sequence, b: Sequence, limit: int) -> bool:
    """Whether a and b, strings or lists of words, are within limit edits: Hyyrö's banded bit-parallel recurrence, a band of 2 * limit + 1 diagonals in one integer."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False
    start, stop = 0, min(n, m)
    while start < stop and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[start:n], b[start:m]
    if not a or not b:
        return max(len(a), len(b)) <= limit
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n <= limit:
        return True
    # bit k of a mask is row low + k of the longer string; the band moves down a row with every column
    width = 2 * limit + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus = full & ~((1 << (width - limit - 1)) - 1), 0  # no rows above the first
    score, low, side = limit, limit + 1 - width, top >> 1
    for j in range(m):
        bits = where.get(b[j], 0)
        eq = (bits >> low if low >= 0 else bits << -low) & full
        d0 = (((eq & plus) + plus) ^ plus | eq | minus) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = d0 & plus
        if j < n - limit:  # along the band's lowest diagonal
            score += not d0 & top
        else:  # then along the last row
            score += bool(hp & side) - bool(hn & side)
            side >>= 1
        if score > 2 * limit + m - n:
            return False
        plus, minus = (hn | ~(d0 >> 1 | hp)) & full, d0 >> 1 & hp
        low += 1
    return score <= limit


def allowance(n: np.ndarray | int) -> np.ndarray | int:
    """Edits of code points that lines of n code points are allowed."""
    return sum((np.asarray(n) >= least) * (edits - before) for (least, edits), before in zip(ALLOWED, (0, *(e for _, e in ALLOWED)), strict=False))


def linked(a: str, b: str) -> bool:
    """Whether two lines are within the allowance of the shorter."""
    v, w = a.split(), b.split()
    if min(len(v), len(w)) >= LONG and edit_distance_within(v, w, WORD_EDITS):
        return True
    return max(len(v), len(w)) < LONG + WORD_EDITS and edit_distance_within(a, b, int(allowance(min(len(a), len(b)))))


class Runs:
    """Many sequences of symbols at once: lengths, starts, and running hashes from which every part's hash is read."""

    def __init__(self, symbols: np.ndarray, n: np.ndarray):
        self.n = n
        ends = np.cumsum(n)
        self.starts = ends - n
        self.up, self.down = _POWERS.upto(len(symbols) + 1)
        self.total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(mix64(symbols + np.uint64(1)) * self.up[: len(symbols)], out=self.total[1:])

    def part(self, who: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number for a part of each line, equal for equal parts; its bits are not spread yet."""
        start = self.starts[who] + at
        return (self.total[start + size] - self.total[start]) * self.down[start] + size.astype(np.uint64)


#: Which code points separate words, as str.split does; those beyond the table don't.
BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def codes(lines: list[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)


def of_chars(lines: list[str]) -> Runs:
    return Runs(codes(lines).astype(np.uint64), np.array([len(x) for x in lines], np.int64))


def of_words(lines: list[str], chars: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lines, in order, and the lines they are of."""
    blank = BLANK[np.minimum(codes(lines), len(BLANK) - 1)]
    edge = np.zeros(len(blank) + 1, bool)
    edge[chars.starts] = edge[-1] = True
    begin = np.flatnonzero(~blank & (edge[:-1] | np.append(True, blank[:-1])))
    end = np.flatnonzero(~blank & (edge[1:] | np.append(blank[1:], True))) + 1
    return mix64((chars.total[end] - chars.total[begin]) * chars.down[begin] + (end - begin).astype(np.uint64)), np.searchsorted(chars.starts, begin, side="right") - 1


def line_keys(lines: list[str]) -> np.ndarray:
    """64-bit keys of lines."""
    runs = of_chars(lines)
    return mix64(runs.part(np.arange(len(lines)), np.zeros(len(lines), np.int64), runs.n))


def in_parts(lines: list[str], chars: int = 100_000) -> Iterator[list[str]]:
    """The lines in runs of about so many code points, which bounds what the hashing arrays need."""
    part, held = [], 0
    for x in lines:
        part.append(x)
        held += len(x)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def keys_and_lengths(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    keys = [line_keys(part) for part in in_parts(lines)]
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.array([len(x) for x in lines], np.int64)


def segments(n: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment k of lines of length n: even parts, the longer ones last."""
    parts = edits + 1
    short = n // parts
    longer = n - short * parts  # so many last parts are one longer
    return k * short + np.maximum(0, k - (parts - longer)), short + (k >= parts - longer)


def entry_key(length: np.ndarray, k: int, part: np.ndarray, unit: int) -> np.ndarray:
    """An entry's number; its last bit tells the unit of its edits (0: code points, 1: words)."""
    place = (length.astype(np.uint64) * np.uint64(64) + np.uint64(2 * k + unit)) * np.uint64(0xA24BAED4963EE407)
    return mix64(part ^ place) & ~np.uint64(1) | np.uint64(unit)


def probes(runs: Runs, edits: int, own: np.ndarray, meets: list[np.ndarray], unit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(entries, lines, probing): the segments of the lines own, and the substrings with which the lines meets[less] probe lines that are `less` symbols shorter."""
    for k in range(edits + 1):
        n = runs.n[own]
        s, size = segments(n, k, edits)
        yield entry_key(n, k, runs.part(own, s, size), unit), own, False
        for less, who in enumerate(meets):
            n = runs.n[who] - less
            s, size = segments(n, k, edits)
            # left bound: at most k edits lie before segment k; right bound: at most edits - k behind it
            for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                ok = (s + shift >= 0) & (s + shift + size <= runs.n[who])
                yield entry_key(n[ok], k, runs.part(who[ok], (s + shift)[ok], size[ok]), unit), who[ok], True


def entries(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, line, probing) of distinct lines."""
    found: list[tuple[np.ndarray, np.ndarray, bool]] = []
    chars = of_chars(lines)
    symbols, of = of_words(lines, chars)
    words = np.bincount(of, minlength=len(lines))
    short = words < LONG + WORD_EDITS
    for _, edits in ALLOWED:
        meets = [np.flatnonzero(short & (allowance(chars.n - less) == edits)) for less in range(edits + 1)]
        found += probes(chars, edits, meets[0], meets, 0)
    at = np.flatnonzero(words >= LONG)
    if len(at):
        runs = Runs(symbols[words[of] >= LONG], words[at])
        meets = [np.flatnonzero(runs.n - less >= LONG) for less in range(WORD_EDITS + 1)]
        found += [(e, at[who], probing) for e, who, probing in probes(runs, WORD_EDITS, meets[0], meets, 1)]
    return tuple(np.concatenate(x) for x in zip(*((e, who, np.full(len(who), probing)) for e, who, probing in found), strict=True))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, key, n): every non-empty line of every row."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows, numbers, lines = [], [], [], []
        for d, r, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), texts(b.column("text")), strict=True):
            found = [(i, x) for i, x in enumerate(lines_of(t)) if x]
            ids += [d] * len(found)
            rows += [r] * len(found)
            numbers += [i for i, _ in found]
            lines += [x for _, x in found]
        keys, n = keys_and_lengths(lines)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int64()), pa.array(keys.view(np.int64)), pa.array(n)], names=["doc_id", "row", "line", "key", "n"])

    return by_batch(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text"), f, "doc_id long, row long, line long, key long, n long")


def meetings(docs: DataFrame) -> DataFrame:
    """(entry, key): the lines at every index entry that a different line probes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2048):
                every = list({x for t in texts(part.column("text")) for x in lines_of(t) if len(x) >= ALLOWED[0][0]})
                for lines in in_parts(every):
                    e, who, probing = entries(lines)
                    yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(line_keys(lines).view(np.int64)[who]), pa.array(probing)], names=["entry", "key", "probing"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("entry")), np.asarray(b.column("key")), b.column("probing").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        e, key, probing = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, e))
        e, key, probing = e[order], key[order], probing[order]
        starts = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(e))))
        held = np.minimum.reduceat(probing, starts) == 0  # someone's own segment
        asked = np.maximum.reduceat(probing, starts)
        several = np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)
        live = (held & asked & several)[group]
        e, key = e[live], key[live]
        once = np.append(True, (e[1:] != e[:-1]) | (key[1:] != key[:-1]))[: len(e)]
        if once.any():
            yield pa.RecordBatch.from_arrays([pa.array(e[once]), pa.array(key[once])], names=["entry", "key"])

    sent = in_arrow(docs.select("text"), emit, "entry long, key long, probing boolean").repartition(partitions(docs.sparkSession), "entry")
    return in_arrow(sent, meet, "entry long, key long")


def connecting(group: list[tuple[int, str, bool]], unit: int) -> list[tuple[int, int]]:
    """Keys of pairs of lines (key, line, side) within the edits that connect what is apart; where both sides occur, pairs across them alone. Ends as soon as all is connected."""
    if len(group) < 2:
        return []
    lines = [(g[0], g[1].split() if unit else g[1], g[2]) for g in group]
    lines.sort(key=lambda g: len(g[1]))
    two, apart = any(g[2] for g in lines), len(lines)
    up, found = list(range(len(lines))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for p, (key, line, side) in enumerate(lines):
        if apart == 1:
            break
        edits = WORD_EDITS if unit else int(allowance(len(line)))
        for q in range(p + 1, len(lines)):
            other = lines[q]
            if len(other[1]) - len(line) > edits:
                break
            if two and side == other[2] or (r := root(p)) == (s := root(q)):
                continue
            if edit_distance_within(line, other[1], edits):
                up[max(r, s)] = min(r, s)
                apart -= 1
                found.append((key, other[0]))
    return found


def line_links(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): keys of lines within the edits of each other that connect what any such lines connect.

    first has (key, row) of every distinct line: the lines' own texts are read from there once more.
    """
    met = settled(meetings(docs))
    # entries with the same lines say the same: one of them is enough
    same = met.groupBy("entry").agg(F.count("*").alias("lines"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    chosen = same.groupBy("lines", "a", "b").agg(F.min("entry").alias("entry"))
    member = met.join(chosen.select("entry", "lines"), "entry")
    wanted = settled(met.select("key").distinct().join(first, "key").select("key", "row"))
    # texts of the lines that met anything: the rows that hold them are read once more
    rows = settled(wanted.groupBy("row").agg(F.collect_set("key").alias("keys")))

    def pick(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, lines = [], []
        for t, w in zip(texts(b.column("text")), b.column("keys").to_pylist(), strict=True):
            w = set(w)
            found = [x for x in lines_of(t) if x]
            for k, x in zip(keys_and_lengths(found)[0].view(np.int64).tolist(), found, strict=True):
                if k in w:
                    w.discard(k)
                    keys.append(k)
                    lines.append(x)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.string())], names=["key", "text"]) if keys else None

    keyed_rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    lines = settled(by_batch(keyed_rows.join(small(rows, 40 + 8 * F.size("keys")), "row").select("text", "keys"), pick, "key long, text string").dropDuplicates(["key"]))
    dealt = member.join(lines, "key").withColumn("blocks", F.ceil(F.col("lines") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    dealt = dealt.withColumn("p", pair).select("entry", "p.i", "p.j", (F.col("own") != F.col("p.i")).alias("side"), "key", "text")
    dealt = dealt.repartition(partitions(docs.sparkSession), "entry", "i", "j").sortWithinPartitions("entry", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def compare() -> None:
            out.extend(connecting(group, now[0] & 1 if now else 0))

        for b in batches:
            for e, i, j, side, k, t in zip(*(b.column(x).to_pylist() for x in ("entry", "i", "j", "side", "key", "text")), strict=True):
                if (e, i, j) != now:
                    compare()
                    now, group = (e, i, j), []
                group.append((k, t, side))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
                out.clear()
        compare()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return in_arrow(dealt, run, "a long, b long").distinct()


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All line occurrences, and (key, class): the class of every line that is linked to a different one. A class's id is its least key."""
    every = settled(occurrences(docs))
    first = every.where(F.col("n") >= ALLOWED[0][0]).groupBy("key").agg(F.min("row").alias("row"))
    links = settled(line_links(docs, first))
    return every, components(links).select(F.col("node").alias("key"), F.col("component").alias("class"))


def ranked(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, class, lead, lead_line, shared, leads): of every class's occurrences, the one in the least (doc_id, row, line) leads."""
    every, linked = classed(docs)
    rows = settled(every.join(linked, "key", "left").select("doc_id", "row", "line", F.coalesce("class", "key").alias("class")).distinct())
    least = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")).alias("l"), F.count("*").alias("times"))
    # written first, so that both sides of the join are plain shuffles and a class of very many rows can be split
    several = settled(least.where("times > 1").select("class", F.col("l.row").alias("lead_row"), F.col("l.line").alias("lead_line"), F.col("l.doc_id").alias("lead")))
    joined = rows.join(several, "class", "left")
    return joined.select("doc_id", "row", "line", "class", "lead", "lead_line", F.col("lead_row").isNotNull().alias("shared"), (F.col("lead_row").isNull() | ((F.col("lead_row") == F.col("row")) & (F.col("lead_line") == F.col("line")))).alias("leads"))


def query(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, its non-empty lines, those of classes with several occurrences, those that another line leads, the leading documents of these by line, and the classes of the shared lines: each line's number with the doc_id and line number that lead its class."""
    lead = F.coalesce(F.col("lead").cast("string"), F.lit("-"))
    lines = ranked(docs).groupBy("row").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("shared").cast("long")).alias("n_shared"), F.sum((~F.col("leads")).cast("long")).alias("n_duplicate"),
        F.array_sort(F.collect_list(F.when(~F.col("leads"), F.struct("line", lead.alias("of"))))).alias("l"),
        F.array_sort(F.collect_list(F.when(F.col("shared"), F.struct("line", F.concat_ws(":", lead, "lead_line").alias("of"))))).alias("c"),
    )

    def said(c: str, sign: str) -> Column:
        return F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(sign, x["line"], x["of"])), ","), F.lit(""))

    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    zero = F.lit(0).cast("long")
    return d.join(lines, "row", "left").select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_shared", zero).alias("n_shared"), F.coalesce("n_duplicate", zero).alias("n_duplicate"), said("l", ":").alias("duplicates"), said("c", "=").alias("classes"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with every line that another leads taken out of its text; of identical rows all lose the same lines. n_chars, where there is one, is that of the new text. Rows stay, even where no line does."""
    names = docs.columns
    mark = fresh(names, "__row")
    lost = fresh([*names, mark], "__gone")
    gone = settled(ranked(docs).where(~F.col("leads")).groupBy(F.col("row").alias(mark)).agg(F.collect_set("line").alias(lost)))
    gone = small(gone, 40 + 8 * F.size(lost))
    keyed = docs.withColumn(mark, F.xxhash64("doc_id", "text"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for t, g in zip(texts(b.column("text")), b.column(lost).to_pylist(), strict=True):
            g = set(g)
            kept.append(BREAK.join(x for i, x in enumerate(t.split(BREAK)) if i not in g))
        made = {"text": pa.array(kept, pa.string())} | ({"n_chars": pa.array([len(t) for t in kept], b.schema.field("n_chars").type)} if "n_chars" in names else {})
        return pa.RecordBatch.from_arrays([made.get(n, b.column(n)) for n in names], names=names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    changed = by_batch(keyed.join(gone, mark).select(*names, lost), cut, types)
    return keyed.join(gone.select(mark), mark, "left_anti").select(*names).unionByName(changed)
