"""What ends a call or cuts a reply short, from finished tables of turns: scans by call instead of counters in a process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.operators.scan import MOST, PIECE, counted, last, pieced, running, scanned
from belltower.operators.sequences import beside, failure_runs, first_after

FAILURES, SILENT_SECONDS, CALL_SECONDS = 3, 20.0, 900.0


def until_failures(rows: DataFrame, key: str, order: str, ok: Column, cap: int = FAILURES, most: int = MOST) -> DataFrame:
    """The rows up to each key's first run of `cap` failures, its last failure with them: a poll that stops."""
    r = failure_runs(pieced(rows, key, order, most), key, order, ok)
    r = scanned(r, key, (order,), {"__stops": counted(F.col("failures") >= cap, before=True)})
    return r.where(F.coalesce("__stops", F.lit(0)) == 0).select(*rows.columns)


def silence_runs(rows: DataFrame, key: str, order: str, heard: Column, audio: Column, wall: Column, most: int = MOST) -> DataFrame:
    """`silent_seconds`: what a call has waited since something was last heard, a turn counting the longer of its audio and its wall time. Keeps the number of a row's piece, if `rows` has one."""
    r = (rows if PIECE in rows.columns else pieced(rows, key, order, most)).withColumn("__heard", heard)
    lost = F.when(~F.col("__heard"), F.greatest(audio, wall)).otherwise(0.0)
    r = scanned(r, key, (order,), {"__all": running(lost)})
    r = scanned(r, key, (order,), {"__then": last(F.when(F.col("__heard"), F.col("__all")), before=False)})
    # a difference of two sums: rounded to microseconds, so that it is 0 where nothing was lost
    return r.withColumn("silent_seconds", F.round(F.col("__all") - F.coalesce("__then", F.lit(0.0)), 6)).drop("__heard", "__all", "__then", *([] if PIECE in rows.columns else [PIECE]))


def call_ends(turns: DataFrame, key: str, order: str, t: str, heard: Column, audio: Column, wall: Column, ok: Column, max_failures: int = FAILURES, max_silence: float = SILENT_SECONDS, max_seconds: float = CALL_SECONDS, most: int = MOST) -> DataFrame:
    """(key, order, reason): the first turn at which a call is over: too many failures in a row, too long a silence, or past its deadline (0: none). Calls that go on have no row."""
    r = silence_runs(failure_runs(pieced(turns, key, order, most), key, order, ok), key, order, heard, audio, wall)
    r = beside(r, turns.groupBy(key).agg(F.min(t).alias("__began")), key)
    late = F.lit(False) if not max_seconds else F.col(t) - F.col("__began") >= max_seconds
    reason = F.when(F.col("failures") >= max_failures, "failures").when(F.col("silent_seconds") >= max_silence, "silence").when(late, "deadline")
    over = r.withColumn("reason", reason).where("reason IS NOT NULL")
    return over.groupBy(key).agg(F.min_by(F.struct(F.col(order).alias("turn"), "reason"), order).alias("e")).select(key, "e.turn", "e.reason")


def live_chunks(chunks: DataFrame, interruptions: DataFrame, key: str) -> DataFrame:
    """The chunks (key, reply, t, seconds) that still play: an interruption (key, t) while a reply plays drops the rest of that reply; the welcome (reply 0) can't be interrupted, and without a reply there is nothing to drop."""
    replies = chunks.where("reply > 0").groupBy(key, "reply").agg(F.min("t").alias("__from"), F.max(F.col("t") + F.col("seconds")).alias("__to"))
    next_cut = first_after(replies, interruptions, key, "__from", "t").distinct()
    cut = replies.join(next_cut, [key, "__from"]).where(F.col("first_after") < F.col("__to")).select(key, "reply", F.col("first_after").alias("__at"))
    return chunks.join(cut, [key, "reply"], "left").where(F.col("__at").isNull() | (F.col("t") <= F.col("__at"))).drop("__at")
