"""Calls as keyed state of a stream: a start registers a call, any of several ends removes it, and timers end what nobody ends."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "call_id string, seq long, kind string, t double, reply long"
ENDED = "call_id string, reason string, t double, events long, failures long, played long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Seconds that a call may last (0: no limit) and may be silent, failures in a row that end it, and seconds that an ended call is remembered, so that what comes late doesn't begin it again."""

    seconds: float = 900.0
    silence: float = 20.0
    failures: int = 3
    memory: float = 600.0


@dataclass
class Call:
    began: float
    heard: float
    events: int = 0
    failures: int = 0
    played: int = 0
    ended: float = -1.0

    def due(self, rules: Rules) -> tuple[float, str]:
        """When a timer ends the call if nothing happens, and why; the deadline goes before a silence of the same moment."""
        late = (self.began + rules.seconds, "deadline") if rules.seconds else (float("inf"), "deadline")
        return min(late, (self.heard + rules.silence, "silence"))

    def take(self, kind: str, t: float, cut: bool, rules: Rules) -> str | None:
        """Counts an event; the reason if it ends the call. cut: its reply was interrupted before."""
        self.events += 1
        if kind in ("heard", "interrupted"):
            self.heard = t
        elif kind == "ok":
            self.failures = 0
        elif kind == "failed":
            self.failures += 1
            if self.failures >= rules.failures:
                return "failures"
        elif kind == "chunk" and not cut:
            self.played += 1
        return "hangup" if kind == "hangup" else None


class Calls(StatefulProcessor):
    """State of one call: its counts, the sequence numbers claimed so far, and the replies that were interrupted."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "began double, heard double, events long, failures long, played long, ended double")
        self.claimed = handle.getMapState("claimed", "seq long", "t double")
        self.cuts = handle.getMapState("cuts", "reply long", "t double")

    def _held(self) -> Call | None:
        return Call(*self.call.get()) if self.call.exists() else None

    def _keep(self, c: Call) -> None:
        self.call.update((c.began, c.heard, c.events, c.failures, c.played, c.ended))

    def _timer(self, t: float) -> None:
        self.handle.registerTimer(int(t * 1000))

    def _end(self, key: Any, c: Call, reason: str, t: float) -> Row:
        """The call's row; nothing but a note that it has ended stays."""
        c.ended = t
        self.claimed.clear()
        self.cuts.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self._timer(t + self.rules.memory)
        self._keep(c)
        return Row(call_id=key[0], reason=reason, t=t, events=c.events, failures=c.failures, played=c.played)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        c = self._held()
        for e in sorted(rows, key=lambda r: (r.t, r.seq)):
            if c is None:
                if e.kind != "started":
                    continue  # of a call that nobody has begun
                c = Call(e.t, e.t)
            if c.ended >= 0:
                break
            at, reason = c.due(self.rules)
            if at <= e.t:  # the timer's moment came before this event, only its firing didn't
                yield self._end(key, c, reason, at)
                break
            if self.claimed.containsKey((e.seq,)):
                continue
            self.claimed.updateValue((e.seq,), (e.t,))
            cut = e.reply is not None and self.cuts.containsKey((e.reply,))
            if e.kind == "interrupted" and e.reply:  # the welcome, reply 0, can't be interrupted
                self.cuts.updateValue((e.reply,), (e.t,))
            if reason := c.take(e.kind, e.t, cut, self.rules):
                yield self._end(key, c, reason, e.t)
                break
        if c is not None and c.ended < 0:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self._timer(c.due(self.rules)[0])
            self._keep(c)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        c = self._held()
        if c is None:
            return
        if c.ended >= 0:
            self.call.clear()
            return
        at, reason = c.due(self.rules)
        if int(at * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._end(key, c, reason, at)

    def close(self) -> None:
        pass


def ended_calls(events: DataFrame, rules: Rules | None = None, watermark: str = "5 seconds") -> DataFrame:
    """One row (of ENDED) for each call of a stream of EVENTS when it ends: hung up, too many failures in a row, silent too long, or past its deadline.

    kinds: started, heard, ok, failed, chunk (of a reply), interrupted (a reply: its further
    chunks aren't played), hangup. Of events with one sequence number the first counts; events
    before a start, after an end, or older than the watermark are left out. Both timers are in
    event time and fire once the watermark passes them. State is in RocksDB, which the session
    must be set to use.
    """
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    timed = events.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("at", watermark)
    return timed.groupBy("call_id").transformWithState(Calls(rules or Rules()), ENDED, "Append", "EventTime")
