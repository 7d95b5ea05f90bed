from __future__ import annotations

import random

import pytest

from belltower.streaming import calls

RULES = calls.Rules(seconds=100.0, silence=12.0, failures=3, memory=50.0)
BASE = 10_000.0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, calls.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def ran(spark, tmp_path, batches, name):
    """Rows of all runs; after each batch the query ends and begins again from its checkpoint."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, calls.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(calls.EVENTS).parquet(str(folder))
        q = calls.ended_calls(stream, RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None, k
    return sorted((r["call_id"], r["reason"], round(r["t"] - BASE, 3), r["events"], r["failures"], r["played"]) for r in spark.read.schema(calls.ENDED).parquet(str(tmp_path / "out")).collect())


def e(call, seq, kind, t, reply=None):
    return (call, seq, kind, BASE + t, reply)


def test_every_end_removes_a_call_once(rocks, tmp_path):
    first = [e("a", 1, "started", 0), e("a", 2, "heard", 3), e("a", 2, "hangup", 4), e("b", 1, "started", 0), e("b", 2, "failed", 1), e("b", 3, "failed", 2), e("b", 3, "failed", 2.5), e("c", 1, "started", 1), e("d", 9, "heard", 1), e("f", 1, "started", 0)]
    first += [e("g", 1, "started", 0), e("g", 2, "chunk", 1, 5), e("g", 3, "interrupted", 2, 5), e("g", 4, "chunk", 3, 5), e("g", 5, "chunk", 4, 6), e("g", 6, "interrupted", 4.5, 0), e("g", 7, "chunk", 5, 0), e("g", 8, "hangup", 6)]
    second = [e("a", 3, "hangup", 9), e("a", 4, "heard", 9.5), e("b", 4, "ok", 8), e("b", 5, "failed", 9), e("b", 6, "failed", 9.1), e("b", 7, "failed", 9.2), e("a", 1, "started", 10), e("f", 2, "heard", 9)]
    third = [e("f", 2 + k, "heard", 9 + 10 * k) for k in range(1, 10)] + [e("z", 1, "started", 100)]
    fourth = [e("z", 2, "heard", 111), e("f", 30, "hangup", 101)]
    fifth = [e("z", 3, "hangup", 122)]
    out = ran(rocks, tmp_path, [first, second, third, fourth, fifth], "ends")
    assert out == [("a", "hangup", 9.0, 3, 0, 0), ("b", "failures", 9.2, 7, 3, 0), ("c", "silence", 13.0, 1, 0, 0), ("f", "deadline", 100.0, 11, 0, 0), ("g", "hangup", 6.0, 8, 0, 3), ("z", "hangup", 122.0, 3, 0, 0)]


def plainly(events):
    """The same rules, over the whole list of a call's events in order."""
    out = []
    for call in sorted({x[0] for x in events}):
        own, began = sorted((x for x in events if x[0] == call), key=lambda x: (x[3], x[1])), None
        seen, cuts, n, failures, played = set(), set(), 0, 0, 0
        end = None
        for _, seq, kind, t, reply in own:
            if began is None:
                if kind != "started":
                    continue
                began = heard = t
            limits = [(began + RULES.seconds, "deadline"), (heard + RULES.silence, "silence")]
            if min(limits)[0] <= t:
                break
            if seq in seen:
                continue
            seen.add(seq)
            n += 1
            heard = t if kind in ("heard", "interrupted") else heard
            failures = failures + 1 if kind == "failed" else 0 if kind == "ok" else failures
            played += kind == "chunk" and reply not in cuts
            if kind == "interrupted" and reply:
                cuts.add(reply)
            if kind == "hangup" or failures >= RULES.failures:
                end = ("hangup" if kind == "hangup" else "failures", t)
                break
        if began is not None:
            reason, t = end or tuple(reversed(min((began + RULES.seconds, "deadline"), (heard + RULES.silence, "silence"))))
            out.append((call, reason, t - BASE, n, failures, played))
    return out


def test_restarts_change_nothing(rocks, tmp_path):
    rng = random.Random(5)
    events = []
    for k in range(25):
        t, seq = rng.random() * 20, 0
        events.append(e(f"c{k:02}", seq, "started", t))
        while t < 140:
            t += rng.expovariate(0.35)
            seq += rng.random() < 0.9
            events.append(e(f"c{k:02}", seq, rng.choices(["heard", "ok", "failed", "chunk", "interrupted", "hangup"], [8, 3, 3, 8, 2, 0.4])[0], round(t, 3), rng.randint(0, 3)))
    events.sort(key=lambda x: x[3])
    want = plainly(events)
    parts = [[x for x in events if BASE + a <= x[3] < BASE + a + 30] for a in range(0, 180, 30)]
    parts = [p for p in parts if p] + [[e("last", 1, "started", 400)], [e("last", 2, "heard", 410)]]
    out = [r for r in ran(rocks, tmp_path, parts, "restarts") if r[0] != "last"]
    assert [(r[0], r[1], round(r[2], 3), *r[3:]) for r in out] == [(r[0], r[1], round(r[2], 3), *r[3:]) for r in want] and {r[1] for r in want} >= {"hangup", "failures", "silence"}


def test_a_session_with_another_store_is_told(spark):
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != calls.PROVIDER:
        with pytest.raises(ValueError, match="RocksDB"):
            calls.ended_calls(spark.createDataFrame([], calls.EVENTS))
