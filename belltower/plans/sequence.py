"""Sequence queries: order lines stand for packets of flows, events for timed streams, conversations for calls' messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belltower.operators import call_control as C
from belltower.operators import sequences as S
from belltower.sources.tables import table


def packets(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines by ship date; the 16-bit number falls where it turns."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("arrived"), "l_partkey", "l_suppkey", F.pmod(F.col("l_linenumber") * 9001 + F.col("l_orderkey"), F.lit(65536)).cast("long").alias("seq"), (F.col("l_linenumber") * 160).cast("long").alias("stamp"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("size"))
    return p


PACKETS = "packets AS (SELECT l_orderkey AS flow, epoch_us(l_shipdate) AS arrived, l_partkey, l_suppkey, ((l_linenumber * 9001 + l_orderkey) % 65536)::BIGINT AS seq, (l_linenumber * 160)::BIGINT AS stamp, l_returnflag AS kind, l_quantity AS size FROM lineitem)"
ORDER = ("arrived", "l_partkey", "l_suppkey", "seq")
W = "PARTITION BY flow ORDER BY arrived, l_partkey, l_suppkey, seq"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type", "value")


EVENTS = "ev AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, event_type, value FROM events)"
GAP = 40_000.0
#: What names a subject, and up to how many words a message may lean on an earlier one.
SUBJECT, WORDS = "nt", 30


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def reply_chunks(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'view'").select("event_id", "user_id", (F.col("event_id") % 40).alias("reply"), "t", F.lit(2.0).alias("seconds"))


QUERIES = {
    "sequence_unwrap": lambda s, d: S.unwrapped(packets(s, d), "flow", "seq", *ORDER).select("flow", "arrived", "seq", "extended"),
    "packet_loss": lambda s, d: S.loss(S.unwrapped(packets(s, d), "flow", "seq", *ORDER), "flow", "extended"),
    "packet_reordering": lambda s, d: S.reordered(S.unwrapped(packets(s, d), "flow", "seq", *ORDER), "flow", "extended", *ORDER),
    "timestamp_steps": lambda s, d: S.timestamp_steps(packets(s, d), "flow", "stamp", *ORDER).select("flow", "usual_percent", F.array_join("other_steps", ",").alias("other_steps")),
    "packet_pacing": lambda s, d: S.pacing(events(s, d), "user_id", F.col("t"), "t", "event_id"),
    "packet_jitter": lambda s, d: S.jitter(events(s, d).withColumn("stamp", F.col("event_id") * 160), "user_id", F.col("t"), "stamp"),
    "type_histogram": lambda s, d: S.type_histogram(events(s, d), "user_id", "event_type", F.col("t")),
    "size_histogram": lambda s, d: S.size_histogram(packets(s, d), "kind", F.col("size")),
    "bursts": lambda s, d: S.bursts(events(s, d), "user_id", "t", GAP).drop("start", "end"),
    "burst_gaps": lambda s, d: S.burst_gaps(S.bursts(events(s, d), "user_id", "t", GAP), "user_id"),
    "comfort_noise_overlap": lambda s, d: S.near_any(events(s, d).where("event_type = 'click'"), events(s, d).where("event_type = 'view'"), "user_id", "t", 20_000.0).groupBy("user_id").agg(F.count("*").alias("overlapping")),
    "talk_over": lambda s, d: S.talk_over(events(s, d).where("event_type = 'view'").select("user_id", "t"), events(s, d).where("event_type = 'click'").select("user_id", F.col("t").alias("talk_start"), (F.col("t") + 90_000).alias("talk_end")), "user_id").select("user_id", "packets", "overlap_s"),
    "first_stage_after": lambda s, d: S.first_after(events(s, d).where("event_type = 'click'"), events(s, d).where("event_type = 'purchase'"), "user_id", "t", "t").select("user_id", F.round("t", 3).alias("t"), F.round("first_after", 3).alias("first_after")),
    "worst_in_interval": lambda s, d: S.worst_between(events(s, d).where("event_type = 'click'").select("user_id", F.col("t").alias("a"), (F.col("t") + 50_000).alias("b")), events(s, d).where("event_type = 'view'").select("user_id", "t", "value"), "user_id", 5_000.0).select("user_id", F.round("a", 3).alias("a"), "worst"),
    "bounded_history": lambda s, d: S.bounded_history(messages(s, d), "conv_id", "turn", 4, ("user", "assistant")).select("conv_id", "turn", "role"),
    "turn_numbers": lambda s, d: S.turn_numbers(messages(s, d), "conv_id", "turn", "assistant").select("conv_id", "turn", F.col("turn_number").cast("long").alias("turn_number")),
    "follow_up_rewrite": lambda s, d: S.carried_subject(messages(s, d).select("conv_id", "turn", "text"), "conv_id", "turn", F.when(F.contains("text", F.lit(SUBJECT)), F.lit("subject")), F.size(F.split(F.trim("text"), " ")).cast("long"), least_words=WORDS).select("conv_id", "turn", "retrieval_query"),
    "failure_runs": lambda s, d: S.failure_runs(events(s, d), "user_id", "event_id", F.col("value") > 10).select("event_id", F.col("failures").cast("long").alias("failures")),
    "polls_until_failures": lambda s, d: C.until_failures(events(s, d), "user_id", "event_id", F.col("value") > 10).select("event_id"),
    "silence_runs": lambda s, d: C.silence_runs(events(s, d), "user_id", "event_id", F.col("event_type") == "click", F.lit(5.0), (F.col("event_id") % 9).cast("double")).select("event_id", "silent_seconds"),
    "call_ends": lambda s, d: C.call_ends(events(s, d), "user_id", "event_id", "t", F.col("event_type") == "click", F.lit(5.0), (F.col("event_id") % 9).cast("double"), F.col("value") > 10, max_silence=30.0, max_seconds=1_000_000.0),
    "live_chunks": lambda s, d: C.live_chunks(reply_chunks(s, d), events(s, d).where("event_type = 'click'").select("user_id", "t"), "user_id").select("event_id"),
    "large_flows": lambda s, d: S.large_flows(events(s, d), "user_id", "t", 20).select("user_id", "packets"),
}
U = f"u AS (SELECT *, seq + 65536 * sum(wrap) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS extended FROM (SELECT *, CASE WHEN lag(seq) OVER ({W}) - seq > 30000 THEN 1 ELSE 0 END AS wrap FROM packets))"
B = f"b AS (SELECT user_id, burst, min(t) AS s, max(t) AS e, count(*) AS packets FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS burst FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= {GAP} THEN 1 ELSE 0 END AS nw FROM ev)) GROUP BY 1, 2)"
RUNS = """k AS (SELECT *, count(*) FILTER (value > 10) OVER w AS good, count(*) FILTER (event_type = 'click') OVER w AS heard FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, count(*) FILTER (NOT value > 10) OVER (PARTITION BY user_id, good ORDER BY event_id) AS failures, sum(CASE WHEN event_type = 'click' THEN 0.0 ELSE greatest(5.0, event_id % 9) END::DOUBLE) OVER (PARTITION BY user_id, heard ORDER BY event_id) AS silent_seconds FROM k)"""
ORACLE_SQL = {
    "sequence_unwrap": f"WITH {PACKETS}, {U} SELECT flow, arrived, seq, extended FROM u",
    "packet_loss": f"WITH {PACKETS}, {U}, a AS (SELECT flow, max(extended) - min(extended) + 1 AS expected, count(DISTINCT extended) AS received, count(*) AS n FROM u GROUP BY 1) SELECT flow, expected, received, greatest(0, expected - received) AS lost, round(100 * greatest(0, expected - received) / expected, 3) AS loss_percent, n - received AS duplicates FROM a",
    "packet_reordering": f"WITH {PACKETS}, {U} SELECT flow, count(*) FILTER (f) AS reordered FROM (SELECT flow, extended < lag(extended) OVER ({W}) AS f FROM u) GROUP BY 1",
    "timestamp_steps": f"WITH {PACKETS}, d AS (SELECT flow, ((stamp - lag(stamp) OVER ({W})) + 4294967296) % 4294967296 AS step FROM packets) SELECT flow, round(100 * avg((step = 160)::INT), 1) AS usual_percent, coalesce(array_to_string(list_sort(list(DISTINCT step) FILTER (step <> 160))[1:8], ','), '') AS other_steps FROM d WHERE step IS NOT NULL GROUP BY 1",
    "packet_pacing": f"WITH {EVENTS}, g AS (SELECT user_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) * 1000 AS gap FROM ev) SELECT user_id, round(quantile_cont(gap, 0.5), 2) AS median, round(quantile_cont(gap, 0.95), 2) AS p95, round(max(gap), 1) AS maximum FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "type_histogram": f"WITH {EVENTS}, z AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS r FROM ev) SELECT user_id, event_type, count(*) AS packets, round(min(r), 2) AS first_s, round(max(r), 2) AS last_s FROM z GROUP BY 1, 2",
    "size_histogram": f"WITH {PACKETS} SELECT kind, size, count(*) AS packets FROM packets GROUP BY 1, 2",
    "bursts": f"WITH {EVENTS}, {B} SELECT user_id, burst, packets FROM b",
    "burst_gaps": f"WITH {EVENTS}, {B} SELECT * FROM (SELECT user_id, burst, round((s - lag(e) OVER (PARTITION BY user_id ORDER BY s)) * 1000, 3) AS gap_ms FROM b) WHERE gap_ms IS NOT NULL",
    "comfort_noise_overlap": f"WITH {EVENTS} SELECT user_id, count(*) AS overlapping FROM ev c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM ev v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND abs(v.t - c.t) < 20000) GROUP BY 1",
    "talk_over": f"WITH {EVENTS} SELECT c.user_id, count(*) AS packets, round(count(*) * 0.02::DOUBLE, 2) AS overlap_s FROM ev c JOIN ev v ON v.user_id = c.user_id AND v.event_type = 'view' AND v.t > c.t + 0.5 AND v.t <= c.t + 90000 WHERE c.event_type = 'click' GROUP BY c.user_id, c.t",
    "first_stage_after": f"WITH {EVENTS} SELECT c.user_id, round(c.t, 3) AS t, round((SELECT min(p.t) FROM ev p WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.t >= c.t), 3) AS first_after FROM ev c WHERE c.event_type = 'click'",
    "worst_in_interval": f"WITH {EVENTS} SELECT c.user_id, round(c.t, 3) AS a, (SELECT max(v.value) FROM ev v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND v.t BETWEEN c.t AND c.t + 50000) AS worst FROM ev c WHERE c.event_type = 'click'",
    "bounded_history": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 AND role IN ('user', 'assistant') AND coalesce(trim(text), '') <> ''",
    "turn_numbers": "SELECT conv_id, turn, 1 + count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn_number FROM conversations",
    "follow_up_rewrite": f"""WITH m AS (SELECT conv_id, turn, text, CASE WHEN contains(text, '{SUBJECT}') THEN 'subject' END AS s, len(string_split(trim(text), ' ')) AS w FROM conversations),
e AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER p, last_value(CASE WHEN w > {WORDS} THEN text END IGNORE NULLS) OVER p, last_value(text IGNORE NULLS) OVER p) AS earlier FROM m WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, CASE WHEN s IS NOT NULL OR w > {WORDS} OR earlier IS NULL THEN text ELSE earlier || ' ' || text END AS retrieval_query FROM e""",
    "failure_runs": f"WITH {EVENTS}, r AS (SELECT *, count(*) FILTER (value > 10) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM ev) SELECT event_id, count(*) FILTER (NOT value > 10) OVER (PARTITION BY user_id, run ORDER BY event_id) AS failures FROM r",
    "polls_until_failures": f"WITH {EVENTS}, {RUNS}, s AS (SELECT *, min(CASE WHEN failures >= 3 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM f) SELECT event_id FROM s WHERE stop IS NULL OR event_id <= stop",
    "silence_runs": f"WITH {EVENTS}, {RUNS} SELECT event_id, silent_seconds FROM f",
    "call_ends": f"""WITH {EVENTS}, {RUNS}, o AS (SELECT *, CASE WHEN failures >= 3 THEN 'failures' WHEN silent_seconds >= 30 THEN 'silence' WHEN t - min(t) OVER (PARTITION BY user_id) >= 1000000 THEN 'deadline' END AS reason FROM f)
SELECT user_id, min(event_id) AS turn, min_by(reason, event_id) AS reason FROM o WHERE reason IS NOT NULL GROUP BY 1""",
    "live_chunks": f"""WITH {EVENTS}, c AS (SELECT event_id, user_id, event_id % 40 AS reply, t FROM ev WHERE event_type = 'view'), g AS (SELECT user_id, reply, min(t) AS a, max(t + 2.0) AS b FROM c WHERE reply > 0 GROUP BY 1, 2),
x AS (SELECT g.user_id, reply, min(i.t) AS cut FROM g JOIN ev i ON i.user_id = g.user_id AND i.event_type = 'click' AND i.t >= a AND i.t < b GROUP BY 1, 2) SELECT event_id FROM c LEFT JOIN x USING (user_id, reply) WHERE cut IS NULL OR t <= cut""",
    "large_flows": f"WITH {EVENTS} SELECT user_id, count(*) AS packets FROM ev GROUP BY 1 HAVING count(*) >= 20",
}
