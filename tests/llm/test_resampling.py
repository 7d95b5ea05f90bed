from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from belltower.llm import resampling
from tests.llm.helpers import HARD, documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(text):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plainly(rows, items):
    """The contract's rows from counts of whole lists of features."""
    docs = [(i, *found(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in items for b in found(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: 5 * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def test_query_equals_counts_of_whole_texts(spark):
    rng = random.Random(8)
    names = ["Alpha", "beta", "naïve", "x1", "ÉTÉ", "the", "of", "🙂", "z"]
    text = lambda n: "".join(rng.choice(names) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    rows = [*HARD, *((100 + i, text(rng.randint(0, 60))) for i in range(300)), (900, text(40_000)), (901, "word" * 50_000), (902, "-" * 200_000)]
    items = [text(30), None, "", "the of the of beta"]
    target = spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "item_id string, text string")
    out = sorted(map(tuple, resampling.query(documents(spark, rows), target).collect()), key=str)
    assert out == plainly(rows, items)
    assert sum(r[4] is not None for r in out) >= 10
    drawn = {r[0] for r in out if r[4] is not None}
    kept = resampling.resampled(documents(spark, rows), target)
    assert kept.columns == documents(spark, []).columns and {r["doc_id"] for r in kept.collect()} == drawn


def test_empty_tables_and_targets(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert resampling.query(documents(spark, []), none).count() == 0
    out = sorted(map(tuple, resampling.query(documents(spark, HARD), none).collect()), key=str)
    assert out == plainly(HARD, [])


def test_chunks_own_every_start_once():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab é-") for _ in range(rng.randint(0, 200))).encode()
        whole = resampling.buckets_of(text)
        size = rng.randint(1, 40)
        parts = [resampling.buckets_of(p, c) for p, c in resampling.chunks(text, size)]
        assert sum(n for n, _ in parts) == whole[0]
        assert sorted(int(b) for _, x in parts for b in x) == sorted(map(int, whole[1]))


def test_equal_rows_of_a_hot_text_are_each_ranked(spark):
    rows = [(7, "one two three four " * 6)] * 400 + [(i, f"word{i} " * 25) for i in range(100, 200)]
    out = resampling.query(documents(spark, rows), spark.createDataFrame([("a", "one two three")], "item_id string, text string")).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 26)) and len(out) == 500
