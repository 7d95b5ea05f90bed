"""Settings as they were when a call began."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belltower.operators.scan import MOST, last, pieced, scanned


def as_of(calls: DataFrame, versions: DataFrame, scope: str, t: str, names: list[str], defaults: dict[str, str] | None = None, most: int = MOST) -> DataFrame:
    """calls with the map `settings` of what each of the names was in the call's scope at its time `t`.

    versions: (scope, t, name, value), a row for each change; a null value takes a setting back
    to its default, and a change at the very moment of a start counts. Names that were never set
    and have no default are left out of the map. Calls and changes are merged in order and every
    setting's last value is carried forward, in one pass for all names; a change in mid-call
    changes nothing of that call. Of changes of one name at one moment the greatest value counts.
    """
    none = F.lit(None)
    kinds = {f.name: f.dataType for f in calls.schema}
    change = F.struct(F.col("value").alias("v"))
    c = calls.select(F.struct(*calls.columns).alias("__call"), F.col(scope).alias("__scope"), F.col(t).alias("__t"), F.lit(1).alias("__late"), none.cast("string").alias("__name"), none.cast("struct<v:string>").alias("__change"))
    v = versions.where(F.col("name").isin(*names)).select(none.cast(c.schema["__call"].dataType).alias("__call"), F.col(scope).alias("__scope"), F.col(t).cast(kinds[t]).alias("__t"), F.lit(0).alias("__late"), F.col("name").alias("__name"), change.alias("__change"))
    both = pieced(c.unionByName(v), "__scope", "__t", most)
    carried = scanned(both, "__scope", ("__t", "__late", "__change"), {f"__{i}": last(F.when(F.col("__name") == n, F.col("__change")), before=False) for i, n in enumerate(names)})
    known = defaults or {}
    each = [F.struct(F.lit(n).alias("key"), F.coalesce(F.col(f"__{i}")["v"], F.lit(known.get(n)).cast("string")).alias("value")) for i, n in enumerate(names)]
    found = F.map_from_entries(F.filter(F.array(*each), lambda e: e["value"].isNotNull()))
    return carried.where("__late = 1").select("__call.*", found.alias("settings"))


def streamed_as_of(calls: DataFrame, snapshots: DataFrame, scope: str, t: str) -> DataFrame:
    """The same for a stream of calls: snapshots (scope, settings, valid_from, valid_to), a static table of spans as `spans` makes them, is joined by scope; a call of no span has null."""
    s = snapshots.withColumnRenamed(scope, "__scope")
    inside = F.col(scope).eqNullSafe(F.col("__scope")) & (F.col(t) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(t) < F.col("valid_to")))
    return calls.join(s, inside, "left").select(*calls.columns, "settings")


def spans(versions: DataFrame, scope: str, t: str, names: list[str], defaults: dict[str, str] | None = None, most: int = MOST) -> DataFrame:
    """(scope, valid_from, valid_to, settings): what holds between two changes of a scope; the last has no end."""
    moments = versions.where(F.col("name").isin(*names)).select(scope, t).distinct()
    held = as_of(moments, versions, scope, t, names, defaults, most)
    ends = scanned(pieced(held, scope, t, most), scope, (t,), {"valid_to": last(F.col(t))}, backwards=True)
    return ends.select(scope, F.col(t).alias("valid_from"), "valid_to", "settings")
