"""Reporting queries over the supplied tables, and the SQL that checks them.

The tables hold no calls: orders stand for calls, nations and suppliers for departments and
agents, events for call events and dial attempts, documents for knowledge documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belltower.operators import reporting as R
from belltower.sources.tables import table

ANCHOR = "1998-07-01 00:00:00"
HOURS = 720


def calls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.concat(F.lit("ch"), k).alias("channel_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("failed").alias("status"),
        F.when(k % 13 != 0, F.col("o_orderdate")).alias("started_at"),
        F.when(k % 11 != 0, F.floor(F.col("o_totalprice") / 100).cast("long")).alias("duration_seconds"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("ai_handled"),
        F.when(k % 4 == 0, F.concat(F.lit("+"), F.col("o_custkey"))).alias("routed_to_staff_number"),
    )


CALLS = """calls AS (SELECT o_orderkey AS id, 'ch' || o_orderkey AS channel_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS status,
CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS started_at, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 100)::BIGINT END AS duration_seconds,
CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ai_handled, CASE WHEN o_orderkey % 4 = 0 THEN '+' || o_custkey END AS routed_to_staff_number FROM orders)"""


def departments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.cast("long").alias("department_id"), k.cast("string").alias("dtmf_digit"), F.col("n_name").alias("name"), (20 + k).alias("ring_timeout_seconds"),
        F.when(k % 3 == 0, "fallback_number").when(k % 3 == 1, "ai").otherwise("hangup").alias("no_answer_action"),
        F.when(k % 2 == 0, F.concat(F.lit("+9"), k)).alias("fallback_number"), (k % 7 != 6).alias("enabled"),
    )


DEPARTMENTS = """departments AS (SELECT n_nationkey::BIGINT AS department_id, n_nationkey::VARCHAR AS dtmf_digit, n_name AS name, 20 + n_nationkey AS ring_timeout_seconds,
CASE n_nationkey % 3 WHEN 0 THEN 'fallback_number' WHEN 1 THEN 'ai' ELSE 'hangup' END AS no_answer_action, CASE WHEN n_nationkey % 2 = 0 THEN '+9' || n_nationkey END AS fallback_number, n_nationkey % 7 <> 6 AS enabled FROM nation)"""


def agents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("agent_id"), F.col("s_nationkey").cast("long").alias("department_id"), F.col("s_name").alias("name"), (k % 3).alias("priority"),
        F.concat(F.lit("+1"), k).alias("phone_number"), F.when(k % 2 == 0, F.concat(F.lit("+2"), k)).alias("backup_number"), (k % 5 != 0).alias("active"),
    )


AGENTS = """agents AS (SELECT s_suppkey AS agent_id, s_nationkey::BIGINT AS department_id, s_name AS name, s_suppkey % 3 AS priority, '+1' || s_suppkey AS phone_number,
CASE WHEN s_suppkey % 2 = 0 THEN '+2' || s_suppkey END AS backup_number, s_suppkey % 5 <> 0 AS active FROM supplier)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(F.concat(F.lit("ch"), e * 2).alias("channel_id"), F.concat(F.lit("+1"), F.col("user_id")).alias("number"), F.lit("agent").alias("kind"), (1 + e % 3).alias("attempt"), F.when(F.col("event_type") == "purchase", "answered").otherwise(F.col("event_type")).alias("result"))


ATTEMPTS = """attempts AS (SELECT 'ch' || (event_id * 2) AS channel_id, '+1' || user_id AS number, 'agent' AS kind, 1 + event_id % 3 AS attempt, CASE WHEN event_type = 'purchase' THEN 'answered' ELSE event_type END AS result FROM events)"""


def kb_documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    meta = F.when(k % 6 == 5, F.lit("{}")).when(k % 6 == 4, F.lit('{"embedding_space": "old"}')).otherwise(F.lit('{"embedding_space": "main"}'))
    return table(spark, d, "documents").select(k.alias("document_id"), F.when(k % 9 == 8, "failed").otherwise("ready").alias("status"), meta.alias("metadata_json"))


KB = """kb AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 9 = 8 THEN 'failed' ELSE 'ready' END AS status, CASE doc_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 'old' ELSE 'main' END AS space FROM documents),
ch AS (SELECT vec_id % 400 AS document_id, CASE WHEN vec_id % 17 <> 0 THEN embedding END AS embedding FROM embeddings),
cnt AS (SELECT document_id, count(*) AS c, count(embedding) AS e FROM ch GROUP BY 1),
st AS (SELECT kb.document_id, status, coalesce(c, 0) AS chunk_count, coalesce(e, 0) AS embedded_count, space, CASE WHEN status = 'failed' THEN 'processing failed' WHEN coalesce(c, 0) = 0 THEN 'no chunks'
WHEN e < c THEN (c - e)::VARCHAR || ' chunks without embedding' WHEN space IS NULL THEN 'unknown embedding space' WHEN space <> 'main' THEN 'embedded in ' || space END AS reason FROM kb LEFT JOIN cnt USING (document_id))"""


def kb_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("vec_id") % 400).alias("document_id"), F.when(F.col("vec_id") % 17 != 0, F.col("embedding")).alias("embedding"))


def setting_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("event_id")).alias("key"), F.when(F.col("event_id") % 5 == 0, F.lit("maybe")).when(F.col("event_id") % 5 == 1, F.lit(" YES ")).when(F.col("event_id") % 5 == 2, F.col("user_id").cast("string")).when(F.col("event_id") % 5 == 3, F.lit("NaN")).otherwise(F.col("event_type")).alias("value"))
    kinds = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("event_id")).alias("key"), F.when(F.col("event_id") % 3 == 0, "bool").when(F.col("event_id") % 3 == 1, "int").otherwise("choice").alias("kind"), F.lit(10.0).alias("minimum"), F.lit(100.0).alias("maximum"), F.lit("click,view").alias("choices"), F.lit("default").alias("default_value"))
    return e, kinds


def department_rules() -> dict[str, F.Column]:
    return {
        "digit": F.col("dtmf_digit").rlike("^[0-9]$"), "timeout": F.col("ring_timeout_seconds").between(22, 40),
        "action": F.col("no_answer_action").isin("fallback_number", "ai"), "fallback": (F.col("no_answer_action") != "fallback_number") | F.col("fallback_number").isNotNull(),
    }


QUERIES = {
    "department_rules": lambda s, d: departments(s, d).select("department_id", F.array_join(R.broken_rules(department_rules()), ",").alias("broken")),
    "prompt_sections": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.md5(R.sections({"": F.lit("Answer briefly."), "Context": F.when(F.col("turn") % 2 == 0, F.col("text")), "Question": F.col("text")})).alias("digest")),
    "scan_calls": lambda s, d: calls(s, d).select("id", "status", "duration_seconds"),
    "point_lookup": lambda s, d: calls(s, d).where("id = 7").select("id", "status"),
    "status_counts": lambda s, d: R.status_counts(R.since(calls(s, d), ANCHOR, HOURS)),
    "dashboard": lambda s, d: R.dashboard(calls(s, d), ANCHOR, HOURS),
    "call_list": lambda s, d: R.call_list(calls(s, d), 50, "completed").select("id", "status", "started_at"),
    "event_timeline": lambda s, d: R.timeline(table(s, d, "events").select("event_id", "user_id", F.col("ts").alias("at"), "event_type"), F.col("user_id") == 5),
    "nested_agents": lambda s, d: R.nested_agents(departments(s, d), agents(s, d)).select("department_id", F.size("agents").cast("long").alias("n"), F.array_join(F.transform("agents", lambda a: a["name"]), ",").alias("names")),
    "routing_plan": lambda s, d: R.routing_plan(departments(s, d), agents(s, d)),
    "menu_digits": lambda s, d: R.menu_digits(departments(s, d).select("dtmf_digit", "name"), {"0": "operator", "9": "assistant"}),
    "attempt_events": lambda s, d: R.attempt_events(attempts(s, d), calls(s, d).withColumnRenamed("id", "call_id")).select("call_id", "event_type", F.get_json_object("detail", "$.result").alias("result"), F.get_json_object("detail", "$.attempt").alias("attempt")),
    "answered_calls": lambda s, d: R.answered_calls(calls(s, d), attempts(s, d)).select("id", "status", "routed_to_staff_number"),
    "dial_status": lambda s, d: table(s, d, "events").select("event_id", R.dial_status(F.when(F.col("event_id") % 4 == 0, "ANSWER").when(F.col("event_id") % 4 == 1, "NOANSWER").when(F.col("event_id") % 4 == 2, F.upper("event_type"))).alias("result")),
    "index_status": lambda s, d: R.index_status(kb_documents(s, d), kb_chunks(s, d), "main"),
    "health_summary": lambda s, d: R.health_summary(R.index_status(kb_documents(s, d), kb_chunks(s, d), "main")),
    "settings_overlay": lambda s, d: R.settings(*setting_rows(s, d)),
    "json_path_filter": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k >= 50"),
    "json_merge": lambda s, d: table(s, d, "events").select("event_id", R.merged_json(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("t"), F.when(F.col("event_id") % 2 == 0, "0").alias("k")))).alias("m")).select("event_id", F.element_at("m", "k").alias("k"), F.element_at(R.truncated_values(F.col("m"), 3), "t").alias("t")),
    "disjunctive_like": lambda s, d: table(s, d, "documents").where(R.any_contains(F.col("text"), ["thtion", "ouh", "straße"])).select("doc_id"),
    "delete_cascade": lambda s, d: R.delete_cascade(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey"), calls(s, d).where("status = 'failed'"), "id"),
    "ended_by": lambda s, d: table(s, d, "orders").select("o_orderkey", R.ended_by(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 10, F.lit(15_000)).alias("ended_by")),
    "audio_flags": lambda s, d: table(s, d, "lineitem").select(F.explode(R.audio_flags(F.col("l_discount") * 2, -F.col("l_quantity"), -F.col("l_tax") * 1000)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n")),
    "stage_latencies": lambda s, d: R.stage_latencies(table(s, d, "events"), "event_type", "value", F.col("value") > 10),
    "vector_validation": lambda s, d: table(s, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("valid")),
    "hardware_verdict": lambda s, d: table(s, d, "part").select("p_partkey", R.hardware_verdict(F.col("p_retailprice") / 10, F.col("p_size"), F.col("p_size") % 8, F.col("p_partkey") % 16, {"disk": 95, "ram": 8, "vram": 0, "threads": 2}, {"disk": 120, "ram": 16, "vram": 4, "threads": 8}).alias("v")).select("p_partkey", "v.verdict", F.size("v.reasons").cast("long").alias("reasons")),
    "checks_ok": lambda s, d: R.checks_ok(table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 1000).alias("a"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") != "P").alias("b")), ["a", "b"]).select("o_orderkey", "ok"),
}
ORACLE_SQL = {
    "department_rules": f"WITH {DEPARTMENTS} SELECT department_id, concat_ws(',', CASE WHEN NOT regexp_matches(dtmf_digit, '^[0-9]$') THEN 'digit' END, CASE WHEN NOT ring_timeout_seconds BETWEEN 22 AND 40 THEN 'timeout' END, CASE WHEN no_answer_action NOT IN ('fallback_number', 'ai') THEN 'action' END, CASE WHEN no_answer_action = 'fallback_number' AND fallback_number IS NULL THEN 'fallback' END) AS broken FROM departments",
    "prompt_sections": "SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), 'Answer briefly.', CASE WHEN turn % 2 = 0 AND trim(text) <> '' THEN 'Context:' || chr(10) || trim(text) END, CASE WHEN trim(text) <> '' THEN 'Question:' || chr(10) || trim(text) END)) AS digest FROM conversations",
    "scan_calls": f"WITH {CALLS} SELECT id, status, duration_seconds FROM calls",
    "point_lookup": f"WITH {CALLS} SELECT id, status FROM calls WHERE id = 7",
    "status_counts": f"WITH {CALLS} SELECT status, count(*) AS calls FROM calls WHERE started_at >= TIMESTAMP '{ANCHOR}' - INTERVAL {HOURS} HOUR GROUP BY status",
    "dashboard": f"WITH {CALLS} SELECT count(*) AS total_calls, count(*) FILTER (status = 'in_progress') AS active_calls, count(*) FILTER (ai_handled) AS ai_calls, count(routed_to_staff_number) AS staff_calls, round(avg(duration_seconds), 1) AS average_duration_seconds FROM calls WHERE started_at >= TIMESTAMP '{ANCHOR}' - INTERVAL {HOURS} HOUR",
    "call_list": f"WITH {CALLS} SELECT id, status, started_at FROM calls WHERE status = 'completed' ORDER BY started_at DESC NULLS LAST, id LIMIT 50",
    "event_timeline": "SELECT event_id, user_id, ts AS at, event_type FROM events WHERE user_id = 5 ORDER BY ts, event_id",
    "nested_agents": f"WITH {DEPARTMENTS}, {AGENTS} SELECT d.department_id, count(agent_id) AS n, coalesce(string_agg(a.name, ',' ORDER BY priority, a.name, agent_id), '') AS names FROM departments d LEFT JOIN agents a USING (department_id) GROUP BY 1",
    "routing_plan": f"""WITH {DEPARTMENTS}, {AGENTS}, t AS (
SELECT d.department_id, dtmf_digit, 0 AS last, priority, a.name AS agent, agent_id, 0 AS side, phone_number AS number, a.name AS label, 'agent' AS kind FROM departments d JOIN agents a USING (department_id) WHERE enabled AND active
UNION ALL SELECT d.department_id, dtmf_digit, 0, priority, a.name, agent_id, 1, backup_number, a.name || ' (backup)', 'agent_backup' FROM departments d JOIN agents a USING (department_id) WHERE enabled AND active AND coalesce(backup_number, '') <> ''
UNION ALL SELECT department_id, dtmf_digit, 1, NULL, NULL, NULL, 0, fallback_number, name || ' fallback', 'department_fallback' FROM departments WHERE enabled AND no_answer_action = 'fallback_number' AND fallback_number IS NOT NULL)
SELECT department_id, dtmf_digit, row_number() OVER (PARTITION BY department_id ORDER BY last, priority, agent, agent_id, side)::INTEGER AS position, number, label, kind, agent_id FROM t""",
    "menu_digits": f"WITH {DEPARTMENTS}, o AS (SELECT dtmf_digit, name FROM departments) SELECT * FROM o UNION ALL SELECT * FROM (VALUES ('0', 'operator'), ('9', 'assistant')) v(dtmf_digit, name) WHERE dtmf_digit NOT IN (SELECT dtmf_digit FROM o)",
    "attempt_events": f"WITH {CALLS}, {ATTEMPTS} SELECT id AS call_id, 'routing_attempt' AS event_type, result, attempt::VARCHAR AS attempt FROM attempts JOIN calls USING (channel_id)",
    "answered_calls": f"WITH {CALLS}, {ATTEMPTS}, w AS (SELECT channel_id, max_by(number, attempt) AS won FROM attempts WHERE result = 'answered' GROUP BY 1) SELECT id, CASE WHEN won IS NULL THEN status ELSE 'answered_by_staff' END AS status, coalesce(won, routed_to_staff_number) AS routed_to_staff_number FROM calls LEFT JOIN w USING (channel_id)",
    "dial_status": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'answered' WHEN 1 THEN 'noanswer' WHEN 2 THEN lower(event_type) ELSE 'failed' END AS result FROM events",
    "index_status": f"WITH {KB} SELECT document_id, status, chunk_count, embedded_count, reason IS NOT NULL AS stale, coalesce(reason, 'up to date') AS reason FROM st",
    "health_summary": f"WITH {KB} SELECT count(*) AS documents, count(*) FILTER (reason IS NOT NULL) AS stale, count(*) FILTER (reason IS NULL AND status = 'ready') AS searchable, coalesce(bool_and(reason IS NULL), true) AS healthy FROM st",
    "settings_overlay": """WITH st AS (SELECT 's' || event_id AS key, CASE event_id % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN ' YES ' WHEN 2 THEN user_id::VARCHAR WHEN 3 THEN 'NaN' ELSE event_type END AS value FROM events),
sp AS (SELECT 's' || event_id AS key, CASE event_id % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' ELSE 'choice' END AS kind FROM events),
g AS (SELECT key, CASE kind WHEN 'bool' THEN CASE WHEN lower(trim(value)) IN ('true', '1', 'yes', 'on') THEN 'true' WHEN lower(trim(value)) IN ('false', '0', 'no', 'off') THEN 'false' END
WHEN 'int' THEN CASE WHEN try_cast(trim(value) AS BIGINT) BETWEEN 10 AND 100 THEN trim(value) END ELSE CASE WHEN trim(value) IN ('click', 'view') THEN trim(value) END END AS o FROM st JOIN sp USING (key))
SELECT sp.key, kind, coalesce(o, 'default') AS value, o IS NOT NULL AS overridden FROM sp LEFT JOIN g USING (key)""",
    "json_path_filter": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 50",
    "json_merge": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '0' ELSE props->>'$.k' END AS k, substr(event_type, 1, 3) AS t FROM events",
    "disjunctive_like": "SELECT doc_id FROM documents WHERE contains(lower(text), 'thtion') OR contains(lower(text), 'ouh') OR contains(lower(text), 'straße')",
    "delete_cascade": f"WITH {CALLS} SELECT l_orderkey AS id, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM calls WHERE status = 'failed')",
    "ended_by": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'worker' WHEN o_totalprice / 10 >= 15000 - 800 THEN 'MAX DURATION' ELSE 'detector' END AS ended_by FROM orders",
    "audio_flags": "SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN l_discount * 2 > 0.1 THEN 'CLIPPING' END, CASE WHEN -l_quantity < -24 THEN 'LOW' END, CASE WHEN -l_tax * 1000 > -45 THEN 'NOISY' END]) AS flag FROM lineitem) WHERE flag IS NOT NULL GROUP BY flag",
    "stage_latencies": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS average, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(count(*) FILTER (value > 10) / count(*), 4) AS success FROM events GROUP BY 1",
    "vector_validation": "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x : NOT isfinite(x))) = 0 AS valid FROM embeddings",
    "hardware_verdict": """WITH h AS (SELECT p_partkey, p_retailprice / 10 AS disk, p_size AS ram, p_size % 8 AS vram, p_partkey % 16 AS threads FROM part),
r AS (SELECT p_partkey, (disk < 95)::INT + (ram < 8)::INT + (vram < 0)::INT + (threads < 2)::INT AS a, (disk >= 95 AND disk <= 120 - 1e-9)::INT + (ram >= 8 AND ram < 16)::INT + (vram >= 0 AND vram < 4)::INT + (threads >= 2 AND threads < 8)::INT AS b FROM h)
SELECT p_partkey, CASE WHEN a > 0 THEN 'UNSUPPORTED' WHEN b > 0 THEN 'MARGINAL' ELSE 'SUPPORTED' END AS verdict, (a + b)::BIGINT AS reasons FROM r""",
    "checks_ok": "SELECT o_orderkey, o_totalprice > 1000 AND (o_orderkey % 2 <> 0 OR o_orderstatus <> 'P') AS ok FROM orders",
}
