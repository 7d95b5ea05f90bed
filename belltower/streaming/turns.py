"""End of a caller's turn, decided on event streams: one state machine, run over files or over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SILENCE_MS, SPEECH_MS, DETECTOR_MS, GRACE_MS, VOICE_BYTES = 1200.0, 250.0, 200.0, 200.0, 32.0
TALK, VOICE = "talk detector", "no voice frames"
INPUT = "channel_id string, t double, kind string, duration_ms double, packets long, octets long"
OUTPUT = "channel_id string, reason string, last_speech_at double, speech_ms long, decided_at double"
STATE = "began double, talking boolean, talk_began double, spoken double, finished double, seen double, packets long, octets long, voiced double, last_voice double, ended boolean"


@dataclass
class Turn:
    """What is known of one channel's turn."""

    began: float | None = None
    talking: bool = False
    talk_began: float | None = None
    spoken: float = 0.0
    finished: float | None = None
    seen: float | None = None
    packets: int = 0
    octets: int = 0
    voiced: float = 0.0
    last_voice: float | None = None
    ended: bool = False

    def decide(self, now: float) -> tuple[str, float, int, float] | None:
        """The decision that falls due up to `now`: talk detector before voice frames."""
        due = []
        if not self.talking and self.finished is not None and self.spoken >= SPEECH_MS:
            at = self.finished + (SILENCE_MS - DETECTOR_MS) / 1000
            due.append((TALK, self.finished - DETECTOR_MS / 1000, int(self.spoken), at))
        if self.last_voice is not None and self.voiced >= SPEECH_MS:
            due.append((VOICE, self.last_voice, int(self.voiced), self.last_voice + SILENCE_MS / 1000))
        for d in sorted(due, key=lambda d: d[3]):
            if d[3] <= now + 1e-9:
                return d
        return None

    def take(self, e) -> None:
        """One event: started, finished, or the receive counters."""
        self.began = e.t if self.began is None else self.began
        if e.kind == "started":
            if not self.talking:
                self.talking, self.talk_began = True, e.t
            self.finished = None
        elif e.kind == "finished":
            if pd.notna(e.duration_ms) and e.duration_ms > 0:
                self.spoken += e.duration_ms
            elif self.talk_began is not None:
                self.spoken += max(0.0, (e.t - self.talk_began) * 1000 - DETECTOR_MS)
            self.talking, self.talk_began, self.finished = False, None, e.t
        elif e.kind == "counters":
            before = (self.seen, self.packets, self.octets)
            self.seen, self.packets, self.octets = e.t, int(e.packets), int(e.octets)
            if before[0] is not None:
                packets, octets = self.packets - before[1], self.octets - before[2]
                if packets > 0 and octets / packets >= VOICE_BYTES and (e.t - self.began) * 1000 >= GRACE_MS:
                    self.voiced += min(e.t - before[0], 1.0) * 1000
                    self.last_voice = e.t


def decided_by(turn: Turn, e) -> tuple[str, float, int, float] | None:
    """The decision that falls due before an event, which is taken if there is none."""
    found = turn.decide(e.t)
    if found and not (found[3] == e.t and e.kind == "started"):
        return found
    turn.take(e)
    return None


def advance(turn: Turn, events: pd.DataFrame) -> tuple[str, float, int, float] | None:
    """Takes the events in time order; the first decision due before one of them ends the turn."""
    return next((found for e in events.sort_values(["t", "kind"], kind="stable").itertuples() if (found := decided_by(turn, e))), None)


def ends_of_turns(events: DataFrame, tail: float = 3600.0) -> DataFrame:
    """Over a finished table: each channel's decision, with silence after its last event. Rows come sorted by channel and time, and a task holds the state of one channel alone, however long it is."""
    names = ["channel_id", "reason", "last_speech_at", "speech_ms", "decided_at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, turn, last = None, Turn(), 0.0
        for pdf in batches:
            out = []
            for e in pdf.itertuples():
                if e.channel_id != now:
                    if now is not None and not turn.ended and (found := turn.decide(last + tail)):
                        out.append((now, *found))
                    now, turn = e.channel_id, Turn()
                last = e.t
                if not turn.ended and (found := decided_by(turn, e)):
                    turn.ended = True
                    out.append((now, *found))
            yield pd.DataFrame(out, columns=names)
        if now is not None and not turn.ended and (found := turn.decide(last + tail)):
            yield pd.DataFrame([(now, *found)], columns=names)

    held = events.where("channel_id IS NOT NULL").select(*[x.split()[0] for x in INPUT.split(", ")])
    return held.repartition("channel_id").sortWithinPartitions("channel_id", "t", "kind").mapInPandas(run, OUTPUT)


def streamed_ends(events: DataFrame, watermark: str = "2 seconds") -> DataFrame:
    """Over a stream with `t` in seconds: state by channel, an event-time timer where a decision falls due, one row when it does."""
    timed = events.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("at", watermark)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = list(Turn.__dataclass_fields__)
        turn = Turn(**{k: v for k, v in zip(names, state.get, strict=True)}) if state.exists else Turn()
        found = None
        if not turn.ended:
            if state.hasTimedOut:
                found = turn.decide(state.getCurrentWatermarkMs() / 1000 + SILENCE_MS / 1000)
            else:
                found = advance(turn, pd.concat(list(batches)))
        if found:
            turn.ended = True
            yield pd.DataFrame([(key[0], *found)], columns=["channel_id", "reason", "last_speech_at", "speech_ms", "decided_at"])
        state.update(tuple(asdict(turn).values()))
        if not turn.ended:
            open_ends = [x for x in (turn.finished, turn.last_voice) if x is not None]
            if open_ends:
                state.setTimeoutTimestamp(max(int(max(open_ends) * 1000 + SILENCE_MS), state.getCurrentWatermarkMs() + 1))

    return timed.groupBy("channel_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_claims(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The first row of every (channel_id, seq) of a stream with a time `at`; later ones are dropped, and the memory ends with the watermark."""
    return events.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["channel_id", "seq"])


def branches(events: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Events with the branch that handles their type; types without one are dropped."""
    branch = F.coalesce(*[F.when(F.col("type").isin(*types), F.lit(name)) for name, types in kinds.items()])
    return events.withColumn("branch", branch).where("branch IS NOT NULL")
