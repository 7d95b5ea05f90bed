"""Ordered-stream analytics: packet sequences, bursts, overlaps, message histories.

What runs along a flow goes through `scan`, so that a flow (or user, or call) of very many rows is cut into pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belltower.operators.scan import MOST, PIECE, counted, last, pieced, previous, running, scanned
from belltower.sources.stored import settled


def beside(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of told, which has at most one row for each key; a null key is a key."""
    return rows.join(told.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def with_previous(rows: DataFrame, key: str, values: dict[str, str | Column], order: tuple[str, ...], most: int = MOST) -> DataFrame:
    """rows and, by name, what a value was in the row before; null in a flow's first row."""
    found = scanned(pieced(rows, key, order[0], most), key, order, {n: previous(F.col(c) if isinstance(c, str) else c) for n, c in values.items()})
    return found.select(*(c for c in found.columns if c not in values), *(F.col(n)["v"].alias(n) for n in values))


def unwrapped(packets: DataFrame, key: str, seq: str, *order: str, modulus: int = 65536, jump: int = 30000, most: int = MOST) -> DataFrame:
    """`extended`: the sequence number plus a turn of the counter for every fall of more than `jump`."""
    names = packets.columns
    p = with_previous(packets, key, {"__before": seq}, order, most)
    p = scanned(p, key, order, {"__turns": counted(F.coalesce(F.col("__before") - F.col(seq) > jump, F.lit(False)))})
    return p.select(*names, (F.col(seq) + modulus * F.col("__turns")).alias("extended"))


def loss(packets: DataFrame, key: str, seq: str) -> DataFrame:
    """Expected, received, lost, duplicate and percentage figures of every flow, from extended numbers."""
    s = F.col(seq)
    out = packets.groupBy(key).agg((F.max(s) - F.min(s) + 1).alias("expected"), F.countDistinct(s).alias("received"), F.count("*").alias("n"))
    lost = F.greatest(F.lit(0), F.col("expected") - F.col("received"))
    return out.select(key, "expected", "received", lost.alias("lost"), F.round(100 * lost / F.col("expected"), 3).alias("loss_percent"), (F.col("n") - F.col("received")).alias("duplicates"))


def reordered(packets: DataFrame, key: str, seq: str, *order: str, most: int = MOST) -> DataFrame:
    """How often a packet's number is below that of the one before."""
    falls = with_previous(packets, key, {"__before": seq}, order, most)
    return falls.groupBy(key).agg(F.count_if(F.col(seq) < F.col("__before")).alias("reordered"))


def timestamp_steps(packets: DataFrame, key: str, stamp: str, *order: str, usual: int = 160, most: int = MOST) -> DataFrame:
    """Share of usual steps between media timestamps (modulo 2**32), and the first eight other steps."""
    step = F.col(stamp) - F.col("__before")
    d = with_previous(packets, key, {"__before": stamp}, order, most).select(key, F.pmod(step, F.lit(1 << 32)).alias("step")).where("step IS NOT NULL")
    # steps of one size are counted first, so that few rows of a flow meet
    sizes = d.groupBy(key, "step").agg(F.count("*").alias("n")).withColumn("other", F.col("step") != usual)
    first = sizes.where("other").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("step"))).where("r <= 8").groupBy(key).agg(F.sort_array(F.collect_list("step")).alias("other_steps"))
    shares = sizes.groupBy(key).agg(F.round(100 * F.sum(F.when(F.col("other"), 0).otherwise(F.col("n"))) / F.sum("n"), 1).alias("usual_percent"))
    return beside(shares, first, key).select(key, "usual_percent", F.coalesce("other_steps", F.array().cast("array<long>")).alias("other_steps"))


def pacing(packets: DataFrame, key: str, seconds: Column, *order: str, most: int = MOST) -> DataFrame:
    """Median, 95th percentile and maximum of the milliseconds between arrivals."""
    p = with_previous(packets.withColumn("__t", seconds), key, {"__before": "__t"}, order, most)
    g = p.select(key, ((F.col("__t") - F.col("__before")) * 1000).alias("gap")).where("gap IS NOT NULL")
    found = quantiles(g, key, "gap", {"median": 0.5, "p95": 0.95, "maximum": 1.0})
    return found.select(key, F.round("median", 2).alias("median"), F.round("p95", 2).alias("p95"), F.round("maximum", 1).alias("maximum"))


def jitter(packets: DataFrame, key: str, seconds: Column, stamp: str, clock: int = 8000, run: int = 4096, most: int = MOST) -> DataFrame:
    """Final and greatest interarrival jitter in ms: j += (|d| - j) / 16 over the packets of a flow in time order.

    A flow is cut into runs of at most `run` packets. A run takes j to (15/16)**n j + e, whatever
    j is: first every e is found, then where each run starts, then the greatest value inside it,
    so no flow need be held in one place but for one number for each of its runs.
    """
    p = packets.select(key, seconds.alias("__t"), F.col(stamp).cast("double").alias("__s"))
    order = ("__t", "__s")
    p = scanned(with_previous(p, key, {"__bt": "__t", "__bs": "__s"}, order, most), key, order, {"i": running(F.lit(1))})
    d = F.abs((F.col("__t") - F.col("__bt")) * clock - F.pmod(F.col("__s") - F.col("__bs"), F.lit(float(1 << 32))))
    p = p.select(key, d.alias("d"), "i")
    runs = p.groupBy(key, F.floor((F.col("i") - 1) / run).alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("d"))

    def steps(start: Column) -> Column:
        first = F.struct(start.alias("j"), start.alias("most"))

        def step(a: Column, d: Column) -> Column:
            j = F.when(d.isNull(), F.lit(0.0)).otherwise(a["j"] + (d - a["j"]) / 16)
            return F.struct(j.alias("j"), F.greatest(a["most"], j).alias("most"))

        return F.aggregate("d", first, step)

    alone = runs.select(key, "run", F.struct("run", F.size("d").alias("n"), steps(F.lit(0.0))["j"].alias("e")).alias("r"))
    none = F.array().cast("array<double>")
    chained = F.aggregate("r", F.struct(F.lit(0.0).alias("j"), none.alias("starts")), lambda a, r: F.struct((F.pow(F.lit(15 / 16), r["n"]) * a["j"] + r["e"]).alias("j"), F.concat(a["starts"], F.array(a["j"])).alias("starts")))
    starts = alone.groupBy(key).agg(F.sort_array(F.collect_list("r")).alias("r")).select(key, F.posexplode(chained["starts"]).alias("run", "start"))
    found = runs.join(starts, [key, "run"]).select(key, "run", steps(F.col("start")).alias("a"))
    per_ms = 1000 / clock
    return found.groupBy(key).agg(F.round(F.max_by("a.j", "run") * per_ms, 2).alias("jitter"), F.round(F.max("a.most") * per_ms, 2).alias("jitter_max"))


def type_histogram(packets: DataFrame, key: str, kind: str, seconds: Column) -> DataFrame:
    """Packets of every type, with first and last second since the flow began."""
    each = packets.withColumn("__t", seconds).groupBy(key, kind).agg(F.count("*").alias("packets"), F.min("__t").alias("a"), F.max("__t").alias("b"))
    begun = F.min("a").over(Window.partitionBy(key))  # over a row for each type
    return each.select(key, kind, "packets", F.round(F.col("a") - begun, 2).alias("first_s"), F.round(F.col("b") - begun, 2).alias("last_s"))


def size_histogram(packets: DataFrame, key: str, size: Column) -> DataFrame:
    return packets.groupBy(key, size.alias("size")).agg(F.count("*").alias("packets"))


def bursts(packets: DataFrame, key: str, t: str, min_gap: float, most: int = MOST) -> DataFrame:
    """Runs of packets; one begins where the gap is at least min_gap (an equal gap separates)."""
    p = with_previous(packets.select(key, t), key, {"__before": t}, (t,), most)
    marked = scanned(p, key, (t,), {"burst": counted(F.coalesce(F.col(t) - F.col("__before") >= min_gap, F.lit(False)))})
    return marked.groupBy(key, "burst").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("packets"))


def burst_gaps(found: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """Milliseconds from the end of each burst to the next's start."""
    g = with_previous(found, key, {"__end": "end"}, ("start",), most)
    return g.select(key, "burst", F.round((F.col("start") - F.col("__end")) * 1000, 3).alias("gap_ms")).where("gap_ms IS NOT NULL")


def near_any(left: DataFrame, right: DataFrame, key: str, t: str, within: float) -> DataFrame:
    """Rows of left with a row of right of the same key less than `within` away: an equi-join on time cells, each row of left probing its own and both neighbours."""
    cell = lambda c: F.floor(F.col(c) / within).cast("long")
    r = right.select(F.col(key).alias("__k"), F.col(t).alias("__t"), cell(t).alias("__c")).distinct()
    probe = left.withColumn("__cell", F.explode(F.array(*[cell(t) + i for i in (-1, 0, 1)])))
    hit = probe.join(r, (F.col(key) == F.col("__k")) & (F.col("__cell") == F.col("__c")) & (F.abs(F.col(t) - F.col("__t")) < within), "left_semi")
    return hit.drop("__cell").distinct()


def talk_over(packets: DataFrame, talks: DataFrame, key: str, delay: float = 0.5, seconds: float = 0.02, most: int = MOST) -> DataFrame:
    """Seconds of packets after a talk's start plus delay and up to its end: packets and both ends of the talks are merged in order, and the running counts at the ends are subtracted, so nothing is joined row by row."""
    none = F.lit(None).cast("double")
    p = packets.select(key, F.col("t").alias("__t"), F.lit(0).alias("__sign"), none.alias("talk_start"))
    ends = talks.select(key, "talk_start", F.explode(F.array(F.struct((F.col("talk_start") + delay).alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("talk_end").alias("t"), F.lit(1).alias("sign")))).alias("e"))
    both = p.unionByName(ends.select(key, F.col("e.t").alias("__t"), F.col("e.sign").alias("__sign"), "talk_start"))
    both = both.withColumn("__end", F.abs("__sign"))
    counts = scanned(pieced(both, key, "__t", most), key, ("__t", "__end"), {"__n": counted(F.col("__sign") == 0)}).where("__sign <> 0")
    found = counts.groupBy(key, "talk_start").agg(F.sum(F.col("__n") * F.col("__sign")).alias("packets")).where("packets > 0")
    return found.select(key, "talk_start", "packets", F.round(F.col("packets") * seconds, 2).alias("overlap_s"))


def first_after(anchors: DataFrame, stages: DataFrame, key: str, anchor: str, t: str, most: int = MOST) -> DataFrame:
    """For every anchor the first stage time at or after it: both are merged in order and the next stage time is carried back, so nothing is joined row by row."""
    a = anchors.select(key, F.col(anchor).alias("__t"), F.lit(0).alias("__stage"))
    s = stages.select(key, F.col(t).alias("__t"), F.lit(1).alias("__stage"))
    both = pieced(a.unionByName(s), key, "__t", most)
    both = scanned(both, key, ("__t", "__stage"), {"first_after": last(F.when(F.col("__stage") == 1, F.col("__t")), before=False)}, backwards=True)
    return both.where("__stage = 0").select(key, F.col("__t").alias(anchor), "first_after")


def worst_between(intervals: DataFrame, samples: DataFrame, key: str, cell: float) -> DataFrame:
    """The greatest value of samples within each interval; without samples null. Cells of time that an interval covers whole are met by their greatest value, and only those at its ends sample by sample; cell: about a tenth of an interval."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    s = samples.select(key, "t", "value", at("t").alias("__c"))
    i = intervals.select(key, "a", "b").distinct()
    inner = i.where(at("b") - at("a") > 1).withColumn("__c", F.explode(F.sequence(at("a") + 1, at("b") - 1)))
    covered = inner.join(s.groupBy(key, "__c").agg(F.max("value").alias("value")), [key, "__c"]).select(key, "a", "b", "value")
    edge = i.withColumn("__c", F.explode(F.array_distinct(F.array(at("a"), at("b"))))).join(s, [key, "__c"])
    edge = edge.where((F.col("t") >= F.col("a")) & (F.col("t") <= F.col("b"))).select(key, "a", "b", "value")
    worst = covered.unionByName(edge).groupBy(key, "a", "b").agg(F.max("value").alias("worst"))
    return intervals.join(worst, [key, "a", "b"], "left").select(key, "a", "b", "worst")


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of a value by key, between neighbours as SQL has them, with no key's values in one place: equal values are counted, running counts tell places, and the neighbours of each wanted place are taken out. Nulls don't count."""
    each = settled(rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__n")))  # read more than once below
    each = scanned(pieced(each, key, value), key, (value,), {"__to": running(F.col("__n"))})
    total = each.groupBy(key).agg(F.max("__to").alias("__all"))
    both = beside(each, total, key)
    found = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__all") - 1)
        first, next_ = F.floor(at), F.ceil(at)
        holds = lambda place: (F.col("__to") > place) & (F.col("__to") - F.col("__n") <= place)
        a, b = F.max(F.when(holds(first), F.col(value))), F.max(F.when(holds(next_), F.col(value)))
        found.append((a + (b - a) * F.max(at - first)).alias(name))
    return both.groupBy(key).agg(*found)


def bounded_history(messages: DataFrame, key: str, order: str, n: int, roles: tuple[str, ...]) -> DataFrame:
    """The last n messages (all if n is not positive), then of these the ones of the roles with text."""
    if n > 0:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        messages = messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    return messages.where(F.col("role").isin(*roles) & (F.coalesce(F.trim("text"), F.lit("")) != ""))


def turn_numbers(messages: DataFrame, key: str, order: str, role: str, most: int = MOST) -> DataFrame:
    """One plus the messages of the role before."""
    m = scanned(pieced(messages, key, order, most), key, (order,), {"turn_number": counted(F.col("role") == role, before=True)})
    return m.select(*messages.columns, (1 + F.coalesce("turn_number", F.lit(0))).alias("turn_number"))


def carried_subject(messages: DataFrame, key: str, order: str, subject: Column, words: Column, text: str = "text", least_words: int = 2, most: int = MOST) -> DataFrame:
    """A message of at most so many words without a subject is prefixed with the last subject named before, else the last longer message, else the last one."""
    m = pieced(messages.withColumn("__s", subject).withColumn("__w", words), key, order, most)
    m = scanned(m, key, (order,), {"__1": last(F.col("__s")), "__2": last(F.when(F.col("__w") > least_words, F.col(text))), "__3": last(F.col(text))})
    earlier = F.coalesce("__1", "__2", "__3")
    stand = F.col("__s").isNotNull() | (F.col("__w") > least_words) | earlier.isNull()
    return m.select(*messages.columns, F.when(stand, F.col(text)).otherwise(F.concat_ws(" ", earlier, F.col(text))).alias("retrieval_query"))


def failure_runs(rows: DataFrame, key: str, order: str, ok: Column, most: int = MOST) -> DataFrame:
    """`failures`: consecutive failures up to each row, back to 0 at a success. Keeps the number of a row's piece, if `rows` has one."""
    r = rows if PIECE in rows.columns else pieced(rows, key, order, most)
    r = scanned(r.withColumn("__ok", ok), key, (order,), {"__all": counted(~F.col("__ok"))})
    # failures since the last success are all so far less those up to it
    r = scanned(r, key, (order,), {"__then": last(F.when(F.col("__ok"), F.col("__all")), before=False)})
    return r.withColumn("failures", F.col("__all") - F.coalesce("__then", F.lit(0))).drop("__ok", "__all", "__then", *([] if PIECE in rows.columns else [PIECE]))


def large_flows(packets: DataFrame, key: str, t: str, least: int = 20) -> DataFrame:
    """Flows of at least so many packets, by first arrival."""
    return packets.groupBy(key).agg(F.count("*").alias("packets"), F.min(t).alias("first")).where(F.col("packets") >= least).orderBy("first", key)
