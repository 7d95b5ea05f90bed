"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Test items become windows of consecutive words. The rarest words of every window (by their
count in the training texts) are its anchors; the index stores the postings (word, row,
position) of all anchor words, where a row is told by a key of its doc_id and text. Lists are
shifted by the anchor's offset and intersected, so that what is left are places where all
anchors stand right; there the whole window is compared, in texts that have such places
alone. Proximity search intersects the same lists with a tolerance.

Cases: null texts have no words and are never hit; a null doc_id is judged as any other;
items of fewer words than a window are one window, items without words none; an item without
an id hits and is listed nowhere; repeated rows give repeated results, and rows that share a
doc_id are judged each by its own text; ties between anchors go to the lesser offset; an
empty benchmark or table gives n_hit 0 or an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.llm.common import fits, fresh, settled

WINDOW, ANCHORS = 10, 2
#: What is broadcast, in bytes; beyond, the join shuffles.
MAX_BROADCAST = 24_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def words(c: Column) -> Column:
    """Words of a text in order; of null none."""
    return F.array_remove(F.split(lowered(F.coalesce(c, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, n, items): each distinct window as words joined by spaces, its words' number, and the sorted item ids that hold it."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = w.select("item_id", F.explode(F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("n", F.size(F.split("window", " ")))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def small(df: DataFrame, *wide: str) -> DataFrame:
    """Marked for broadcast if its bytes are within the bound. wide: its columns that are no numbers."""
    size = F.lit(16 * len(df.columns))
    for c in wide:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return F.broadcast(df) if fits(df, size, MAX_BROADCAST) else df


def anchors(wins: DataFrame, docs: DataFrame, k: int = ANCHORS) -> DataFrame:
    """(window, offset, word, rank): the k rarest words of every window in the training texts."""
    terms = wins.select("window", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    wanted = small(settled(terms.select("word").distinct()), "word")
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("times"))
    ranked = terms.join(counts, "word", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # one row for each distinct word of the window, rarest first; at most a window's words meet in one group
    first = ranked.groupBy("window", "word").agg(F.min("times").alias("times"), F.min("offset").alias("offset"))
    few = first.groupBy("window").agg(F.slice(F.array_sort(F.collect_list(F.struct("times", "offset", "word"))), 1, k).alias("a"))
    return few.select("window", F.posexplode("a").alias("rank", "x")).select("window", "rank", "x.offset", "x.word")


def postings(docs: DataFrame, anchor_words: DataFrame) -> DataFrame:
    """The index: (word, row, position) for every place of the given words in the training texts."""
    each = docs.select(row_key().alias("row"), F.posexplode(words(F.col("text"))).alias("position", "word"))
    return each.join(small(settled(anchor_words), "word"), "word", "left_semi").select("word", "row", "position")


def places(index: DataFrame, chosen: DataFrame, tolerance: int = 0) -> DataFrame:
    """(row, window, start) where every anchor list has an entry: exactly, or within tolerance words of its place.

    Rarest list first: the others only filter what it brings.
    """
    first = chosen.where("rank = 0").drop("rank")
    found = index.join(small(first, "word", "window"), "word").select("row", "window", (F.col("position") - F.col("offset")).alias("start")).where(F.col("start") >= -tolerance)
    # what each further list must hold for a start to stay; windows of fewer distinct words have fewer lists
    rest = chosen.where("rank > 0").groupBy("window").agg(F.collect_list(F.struct("word", "offset")).alias("rest"))
    found = settled(found.join(small(rest, "window", "rest"), "window", "left"))
    wanted = found.select("row", "window", "start", F.size("rest").alias("needed"), F.posexplode("rest").alias("k", "a")).select("row", "window", "start", "needed", "k", "a.word", (F.col("start") + F.col("a.offset")).alias("position"))
    if tolerance:  # an entry serves every start near it
        wanted = wanted.withColumn("position", F.explode(F.sequence(F.col("position") - tolerance, F.col("position") + tolerance)))
    met = wanted.join(index, ["row", "position", "word"], "left_semi").groupBy("row", "window", "start").agg(F.max("needed").alias("needed"), F.countDistinct("k").alias("met"))
    return met.where("met = needed").select("row", "window", "start").unionByName(found.where("rest IS NULL").select("row", "window", "start")).distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, tolerance: int = 3, size: int = WINDOW, k: int = ANCHORS) -> DataFrame:
    """(doc_id, window, start): places where the anchors of a window stand within tolerance words of where the phrase has them."""
    wins = settled(windows(items, size))
    chosen = settled(anchors(wins, docs, k))
    index = settled(postings(docs, chosen.select("word").distinct()))
    return docs.select("doc_id", row_key().alias("row")).join(places(index, chosen, tolerance), "row").drop("row")


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, k: int = ANCHORS) -> DataFrame:
    """(row, hit_items, hit_positions) of every row that holds a window: item ids and word positions, each once."""
    wins = settled(windows(items, size))
    chosen = settled(anchors(wins, docs, k))
    index = settled(postings(docs, chosen.select("word").distinct()))
    met = settled(places(index, chosen).join(small(wins, "window", "items"), "window").groupBy("row").agg(F.collect_list(F.struct("start", "n", "window", "items")).alias("starts")))
    # texts of rows with candidates alone, each once
    texts = docs.select(row_key().alias("row"), "text").join(small(met.select("row")), "row", "left_semi").dropDuplicates(["row"])
    both = texts.select("row", words(F.col("text")).alias("w")).join(met, "row")
    same = F.filter("starts", lambda s: F.array_join(F.slice("w", s["start"] + 1, s["n"]), " ") == s["window"])
    both = both.select("row", same.alias("hits")).where(F.size("hits") > 0)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    named = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda s: s["items"]))))
    return settled(both.select("row", named.alias("hit_items"), covered.alias("hit_positions")))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, k: int = ANCHORS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the hit items and the hit word positions of every row."""
    found = hits(docs, items, size, k)
    rows = docs.select("doc_id", row_key().alias("row"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    both = rows.join(small(found, "hit_items", "hit_positions"), "row", "left")
    named, covered = F.coalesce("hit_items", F.array().cast("array<string>")), F.coalesce("hit_positions", F.array().cast("array<int>"))
    return both.select(
        "doc_id",
        "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.size(covered) > 0).alias("contaminated"),
        named.alias("hit_items"),
        covered.alias("hit_positions"),
    )


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).drop("hit_items", "hit_positions")


def clean_only(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows; columns and other rows stay as they are."""
    names = docs.columns
    mark = fresh(names, "__row")
    return docs.withColumn(mark, row_key()).join(small(hits(docs, items).select(F.col("row").alias(mark))), mark, "left_anti").select(*names)


ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
dp AS (SELECT r, doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS p FROM (SELECT r, doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
hit AS (SELECT dp.r, dp.i, dp.n, win.item_id FROM dp JOIN win ON dp.p = win.p AND dp.n = win.n),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY r)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.r = dw.r LEFT JOIN its ON its.r = dw.r"""
