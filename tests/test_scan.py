from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from belltower.operators import call_control as C
from belltower.operators import sequences as S
from belltower.operators.scan import PIECE, Scan, counted, last, pieced, previous, running, scanned


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows have key 1; some keys, values and times are null."""
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        key = 1 if i % 3 == 0 else None if i % 97 == 0 else rng.randint(2, 400)
        rows.append((key, None if i % 501 == 0 else rng.randint(0, 100_000) / 4, i, rng.choice([None, rng.randint(0, 65535)]), rng.random() < 0.3))
    return spark.createDataFrame(rows, "k long, t double, id long, v long, ok boolean").cache()


def order(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("backwards", [False, True])
def test_scans_equal_windows_however_keys_are_cut(hot, backwards):
    way = (F.desc if backwards else F.asc)
    w = Window.partitionBy("k").orderBy(way("t"), way("id"))
    to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = hot.select("k", "id", F.sum("v").over(to).alias("s"), F.sum("v").over(before).alias("sb"), F.min("v").over(to).alias("a"), F.max("v").over(before).alias("b"), F.last("v", ignorenulls=True).over(before).alias("l"), F.lag("v").over(w).alias("p"), F.count_if("ok").over(to).alias("c"))
    columns = want.columns
    for most in (50, 10**6):
        rows = pieced(hot, "k", "t", most)
        assert (PIECE in rows.columns) == (most == 50)
        out = scanned(rows, "k", ("t", "id"), {"s": running(F.col("v")), "sb": running(F.col("v"), before=True), "a": Scan("min", F.col("v")), "b": Scan("max", F.col("v"), True), "l": last(F.col("v")), "p": previous(F.col("v")), "c": counted(F.col("ok"))}, backwards)
        out = out.withColumn("p", F.col("p")["v"])
        assert order(out, *columns) == order(want, *columns)


def test_a_key_with_a_third_of_the_rows_is_dealt_over_many_pieces(hot):
    sizes = pieced(hot, "k", "t", 50).groupBy("k", PIECE).count().collect()
    pieces = [r for r in sizes if r["k"] == 1]
    assert len(pieces) > 60 and max(r["count"] for r in sizes) <= 150
    plan = scanned(pieced(hot, "k", "t", 50), "k", ("t", "id"), {"s": running(F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and f"k#" in plan


def test_equal_times_and_several_keys(spark):
    rows = spark.createDataFrame([(1, "a", 5, i) for i in range(300)] + [(1, "b", i, i) for i in range(300)], "k int, j string, t int, id int")
    out = scanned(pieced(rows, ["k", "j"], "t", 40), ["k", "j"], ("t", "id"), {"n": running(F.lit(1))})
    got = {(r["j"], r["id"]): r["n"] for r in out.collect()}
    assert all(got[j, i] == i + 1 for j in "ab" for i in range(300))
    assert scanned(pieced(rows.limit(0), "k", "t", 1), "k", ("t",), {"n": running(F.lit(1))}).count() == 0


def both(f, columns):
    assert order(f(50), *columns) == order(f(10**6), *columns)


def test_operators_say_the_same_of_hot_keys(hot):
    p = hot.where("t IS NOT NULL AND v IS NOT NULL AND k IS NOT NULL")
    both(lambda m: S.unwrapped(p, "k", "v", "t", "id", most=m), ["k", "id", "extended"])
    both(lambda m: S.reordered(p, "k", "v", "t", "id", most=m), ["k", "reordered"])
    both(lambda m: S.timestamp_steps(p, "k", "v", "t", "id", most=m).withColumn("o", F.array_join("other_steps", ",")), ["k", "usual_percent", "o"])
    both(lambda m: S.pacing(p, "k", F.col("t"), "t", "id", most=m), ["k", "median", "p95", "maximum"])
    both(lambda m: S.jitter(p, "k", F.col("t"), "v", run=16, most=m), ["k", "jitter", "jitter_max"])
    both(lambda m: S.bursts(p, "k", "t", 40.0, m), ["k", "burst", "start", "end", "packets"])
    both(lambda m: S.burst_gaps(S.bursts(p, "k", "t", 40.0), "k", m), ["k", "burst", "gap_ms"])
    both(lambda m: S.first_after(p.where("ok"), p.where("NOT ok"), "k", "t", "t", m), ["k", "t", "first_after"])
    both(lambda m: S.talk_over(p.where("ok").select("k", "t"), p.where("NOT ok").select("k", F.col("t").alias("talk_start"), (F.col("t") + 9).alias("talk_end")).distinct(), "k", most=m), ["k", "talk_start", "packets"])
    both(lambda m: S.failure_runs(p, "k", "id", F.col("ok"), m), ["id", "failures"])
    both(lambda m: S.turn_numbers(p.withColumn("role", F.when(F.col("ok"), "a")), "k", "id", "a", m), ["id", "turn_number"])
    both(lambda m: S.carried_subject(p.withColumn("text", F.col("v").cast("string")), "k", "id", F.when(F.col("v") % 9 == 0, F.col("v").cast("string")), F.col("v") % 5, most=m), ["id", "retrieval_query"])
    both(lambda m: C.until_failures(p, "k", "id", F.col("ok"), 9, m), ["id"])
    both(lambda m: C.silence_runs(p, "k", "id", F.col("ok"), F.lit(5.0), F.col("id") % 9, m), ["id", "silent_seconds"])
    both(lambda m: C.call_ends(p, "k", "id", "t", F.col("ok"), F.lit(5.0), F.col("id") % 9, F.col("ok"), most=m), ["k", "turn", "reason"])


def test_quantiles_equal_the_ones_of_whole_lists(hot, monkeypatch):
    rows = hot.select("k", (F.col("v") / 3).alias("x"))
    want = rows.where("x IS NOT NULL").groupBy("k").agg(F.percentile("x", 0.5).alias("m"), F.percentile("x", 0.95).alias("p"))
    kept = pieced
    for most in (30, 10**6):
        monkeypatch.setattr(S, "pieced", lambda r, k, o, most=most: kept(r, k, o, most))
        got = S.quantiles(rows, "k", "x", {"m": 0.5, "p": 0.95})
        assert [(r[0], round(r[1], 6), round(r[2], 6)) for r in order(got, "k", "m", "p")] == [(r[0], round(r[1], 6), round(r[2], 6)) for r in order(want, "k", "m", "p")]
