"""Call-centre reporting: dashboard figures, call lists, routing plans, index health, settings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(calls: DataFrame, anchor: str, hours: int) -> DataFrame:
    """Calls that started within the hours before the anchor time; a null start is outside. hours: 1 to 720."""
    if not 1 <= hours <= 720:
        raise ValueError("hours must be between 1 and 720")
    return calls.where(F.col("started_at") >= F.to_timestamp(F.lit(anchor)) - F.make_interval(hours=F.lit(hours)))


def status_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("status").agg(F.count("*").alias("calls"))


def dashboard(calls: DataFrame, anchor: str, hours: int) -> DataFrame:
    """One row of figures in one pass over the window."""
    c = since(calls, anchor, hours)
    return c.agg(
        F.count("*").alias("total_calls"),
        F.count_if(F.col("status") == "in_progress").alias("active_calls"),
        F.count_if(F.col("ai_handled")).alias("ai_calls"),
        F.count_if(F.col("routed_to_staff_number").isNotNull()).alias("staff_calls"),
        F.round(F.avg("duration_seconds"), 1).alias("average_duration_seconds"),
    )


def call_list(calls: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """The latest calls, those without a start last; the id settles ties. limit: 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    rows = calls if status is None else calls.where(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("started_at"), "id").limit(limit)


def timeline(events: DataFrame, key: Column) -> DataFrame:
    """The events of one call, in order."""
    return events.where(key).orderBy(F.asc_nulls_last("at"), "event_id")


def nested_agents(departments: DataFrame, agents: DataFrame) -> DataFrame:
    """Each department with its agents by priority and name; without agents an empty list."""
    kids = agents.groupBy("department_id").agg(F.sort_array(F.collect_list(F.struct("priority", "name", "agent_id"))).alias("agents"))
    joined = departments.join(kids, "department_id", "left")
    return joined.withColumn("agents", F.coalesce("agents", F.array().cast(kids.schema["agents"].dataType)))


def routing_plan(departments: DataFrame, agents: DataFrame) -> DataFrame:
    """Dial targets of each enabled department in order: active agents by priority and name, each number before its backup, then the fallback if the no-answer action uses it."""
    d = departments.where("enabled").select("department_id", F.col("name").alias("department"), "dtmf_digit", "ring_timeout_seconds", "no_answer_action", "fallback_number")
    a = agents.where("active").select("department_id", "agent_id", F.col("name").alias("agent"), "priority", "phone_number", "backup_number")
    number = F.posexplode(F.array(F.struct(F.col("phone_number").alias("number"), F.col("agent").alias("label"), F.lit("agent").alias("kind")), F.struct(F.col("backup_number").alias("number"), F.concat("agent", F.lit(" (backup)")).alias("label"), F.lit("agent_backup").alias("kind"))))
    own = d.join(a, "department_id").select("department_id", "department", "dtmf_digit", F.lit(0).alias("last"), "priority", "agent", "agent_id", number.alias("side", "t"))
    own = own.where("t.kind = 'agent' OR coalesce(t.number, '') <> ''").select("department_id", "department", "dtmf_digit", "last", "priority", "agent", "agent_id", "side", "t.number", "t.label", "t.kind")
    fallback = d.where("no_answer_action = 'fallback_number' AND coalesce(fallback_number, '') <> ''").select("department_id", "department", "dtmf_digit", F.lit(1).alias("last"), F.lit(None).cast("long").alias("priority"), F.lit(None).cast("string").alias("agent"), F.lit(None).cast("long").alias("agent_id"), F.lit(0).alias("side"), F.col("fallback_number").alias("number"), F.concat("department", F.lit(" fallback")).alias("label"), F.lit("department_fallback").alias("kind"))
    w = Window.partitionBy("department_id").orderBy("last", "priority", "agent", "agent_id", "side")
    return own.unionByName(fallback).withColumn("position", F.row_number().over(w)).select("department_id", "dtmf_digit", "position", "number", "label", "kind", "agent_id")


def menu_digits(departments: DataFrame, reserved: dict[str, str]) -> DataFrame:
    """Digits and names, with the reserved digits that no department has."""
    own = departments.select("dtmf_digit", "name")
    default = own.sparkSession.createDataFrame(list(reserved.items()), "dtmf_digit string, name string")
    return own.unionByName(default.join(own.select("dtmf_digit"), "dtmf_digit", "left_anti"))


def attempt_events(attempts: DataFrame, calls: DataFrame) -> DataFrame:
    """Dial attempts joined to their call by channel, as JSON details; attempts of unknown channels are dropped."""
    detail = F.to_json(F.struct("attempt", "number", "kind", "result"))
    return attempts.join(calls.select("channel_id", "call_id"), "channel_id").select("call_id", F.lit("routing_attempt").alias("event_type"), detail.alias("detail"))


def answered_calls(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """Calls whose status and staff number follow from their answered attempt (the last one)."""
    won = attempts.where("result = 'answered'").groupBy("channel_id").agg(F.max_by("number", "attempt").alias("won"))
    return calls.join(won, "channel_id", "left").withColumn("status", F.when(F.col("won").isNotNull(), "answered_by_staff").otherwise(F.col("status"))).withColumn("routed_to_staff_number", F.coalesce("won", "routed_to_staff_number")).drop("won")


def dial_status(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for x in ("ANSWER", "answered", "NOANSWER", "noanswer", "BUSY", "busy")])
    return F.coalesce(F.element_at(known, status), F.when(F.coalesce(status, F.lit("")) != "", F.lower(status)), F.lit("failed"))


def index_status(documents: DataFrame, chunks: DataFrame, space: str) -> DataFrame:
    """Chunk counts of every document, and whether its index is stale and why; documents without chunks count 0."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count("embedding").alias("embedded_count"))
    zero = F.lit(0).cast("long")
    rows = documents.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", zero)).withColumn("embedded_count", F.coalesce("embedded_count", zero))
    stored = F.get_json_object("metadata_json", "$.embedding_space")
    reason = (
        F.when(F.col("status") == "failed", "processing failed")
        .when(F.col("chunk_count") == 0, "no chunks")
        .when(F.col("embedded_count") < F.col("chunk_count"), F.format_string("%d chunks without embedding", F.col("chunk_count") - F.col("embedded_count")))
        .when(stored.isNull(), "unknown embedding space")
        .when(stored != space, F.concat(F.lit("embedded in "), stored))
    )
    return rows.select("document_id", "status", "chunk_count", "embedded_count", reason.isNotNull().alias("stale"), F.coalesce(reason, F.lit("up to date")).alias("reason"))


def health_summary(status: DataFrame) -> DataFrame:
    ready = ~F.col("stale") & (F.col("status") == "ready")
    return status.agg(F.count("*").alias("documents"), F.count_if("stale").alias("stale"), F.count_if(ready).alias("searchable"), F.coalesce(F.bool_and(~F.col("stale")), F.lit(True)).alias("healthy"))


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in their order; a rule without an answer is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))


def sections(parts: dict[str, Column]) -> Column:
    """A prompt of titled sections, parted by blank lines; parts that are null or blank are left out."""
    held = [F.when(F.trim(c) != "", F.concat(F.lit(f"{title}:\n") if title else F.lit(""), F.trim(c))) for title, c in parts.items()]
    return F.concat_ws("\n\n", *held)


def checks_ok(checks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per row, whether every check that isn't null holds."""
    return checks.withColumn("ok", F.forall(F.array(*names), lambda x: F.coalesce(x, F.lit(True))))


def settings(stored: DataFrame, spec: DataFrame) -> DataFrame:
    """Stored texts as typed values, over the defaults; unusable ones (not of the kind, out of bounds, not a choice, not finite, unknown key) are skipped."""
    text = F.trim("value")
    number = F.try_cast(text, "double") if hasattr(F, "try_cast") else F.expr("try_cast(trim(value) AS double)")
    low = F.lower(text)
    usable = (
        F.when(F.col("kind") == "bool", low.isin("true", "false", "1", "0", "yes", "no", "on", "off"))
        .when(F.col("kind") == "int", text.rlike(r"^[+-]?\d+$") & number.between(F.col("minimum"), F.col("maximum")))
        .when(F.col("kind") == "float", number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & number.between(F.col("minimum"), F.col("maximum")))
        .when(F.col("kind") == "choice", F.array_contains(F.split("choices", ","), text))
        .otherwise(F.lit(True))
    )
    shown = F.when(F.col("kind") == "bool", low.isin("true", "1", "yes", "on").cast("string")).otherwise(text)
    good = stored.join(spec.drop("default_value"), "key").where(usable).select("key", shown.alias("override"))
    return spec.join(good, "key", "left").select("key", "kind", F.coalesce("override", "default_value").alias("value"), F.col("override").isNotNull().alias("overridden"))


def any_contains(text: Column, terms: Sequence[str]) -> Column:
    """Whether the lower-cased text has any of the terms."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(t)) for t in terms), F.lit(False))


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects of texts as one; the new one's values win."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = parse(old), parse(new)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def truncated_values(m: Column, size: int = 100) -> Column:
    return F.transform_values(m, lambda k, v: F.substring(v, 1, size))


def delete_cascade(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent isn't among those gone."""
    return children.join(parents_gone.select(key), key, "left_anti")


def ended_by(worker: Column, captured_ms: Column, max_ms: Column) -> Column:
    """What ended a turn: the worker, the maximum duration (captured within 800 ms of it), or the detector."""
    return F.when(worker, "worker").when(captured_ms >= max_ms - 800, "MAX DURATION").otherwise("detector")


def audio_flags(clipped: Column, peak: Column, floor: Column) -> Column:
    return F.array_compact(F.array(F.when(clipped > 0.1, "CLIPPING"), F.when(peak < -24, "LOW"), F.when(floor > -45, "NOISY")))


def stage_latencies(rows: DataFrame, key: str, value: str, ok: Column) -> DataFrame:
    """Count, average, median, 95th percentile and share of successes of every stage."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 4).alias("average"), F.round(F.percentile(value, 0.5), 4).alias("median"),
        F.round(F.percentile(value, 0.95), 4).alias("p95"), F.round(F.try_divide(F.count_if(ok), F.count("*")), 4).alias("success"),
    )


def hardware_verdict(disk_gb: Column, ram_gb: Column, vram_gb: Column, threads: Column, least: dict[str, float], wanted: dict[str, float]) -> Column:
    """UNSUPPORTED below any least value, MARGINAL below any wanted one, else SUPPORTED; with the reasons."""
    have = {"disk": disk_gb, "ram": ram_gb, "vram": vram_gb, "threads": threads}
    short = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(0)) < least[k], F.lit(f"{k} below {least[k]:g}")) for k, c in have.items()]))
    scant = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(0)).between(least[k], wanted[k] - 1e-9), F.lit(f"{k} below {wanted[k]:g}")) for k, c in have.items()]))
    verdict = F.when(F.size(short) > 0, "UNSUPPORTED").when(F.size(scant) > 0, "MARGINAL").otherwise("SUPPORTED")
    return F.struct(verdict.alias("verdict"), F.concat(short, scant).alias("reasons"))
