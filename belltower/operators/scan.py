"""Running values along a key's rows in order, however many rows one key has.

A window by key alone puts a key's rows into one task. Here keys of very many rows are cut into
pieces by quantiles of their first order column; windows run by key and piece, and what the
pieces before bring in (sums, extremes, last values: all of them compose) is found from one
summary row a piece and joined as a small table. Other keys are one piece, and tables without
such keys are plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belltower.sources.stored import settled

#: Rows of a piece, about; and the most keys that are cut, and pieces that these have, of a table (twice that many rows are broadcast).
MOST, KEYS = 1_000_000, 100_000
PIECE = "__piece"


class Scan(NamedTuple):
    """kind: sum, min, max or last (the last value that isn't null); of the rows up to each row, itself with them unless `before`."""

    kind: str
    value: Column
    before: bool = False


def running(value: Column, before: bool = False) -> Scan:
    return Scan("sum", value, before)


def counted(condition: Column, before: bool = False) -> Scan:
    return Scan("sum", F.when(condition, 1).otherwise(0).cast("long"), before)


def last(value: Column, before: bool = True) -> Scan:
    """The last value that isn't null, by default of the rows before."""
    return Scan("last", value, before)


def previous(value: Column) -> Scan:
    """The value of the row before, null or not, as a struct's field v."""
    return Scan("last", F.struct(value.alias("v")), True)


def listed(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def pieced(rows: DataFrame, keys: str | Sequence[str], order: str, most: int = MOST) -> DataFrame:
    """rows with the number of their piece, if any key has more than `most` rows; without it, as they are.

    order: the first column of the order, of a type with quantiles. Rows that are equal in it
    stay in one piece; null comes first.
    """
    keys, total = listed(keys), rows.count()
    if total <= most:
        return rows
    rows = settled(rows)
    limit = max(most, total // KEYS)
    hot = settled(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit))
    largest = hot.agg(F.max("__n")).first()[0]
    if largest is None:
        return rows
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    named = F.broadcast(hot.select(*(F.col(k).alias(f"__{k}") for k in keys)))
    parts = -(-largest // limit) * 2
    at = F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts)
    cuts = settled(rows.join(named, on, "left_semi").groupBy(*keys).agg(F.array_distinct(at).alias("__cuts")))
    cuts = F.broadcast(cuts.select(*(F.col(k).alias(f"__{k}") for k in keys), "__cuts"))
    piece = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c <= F.col(order))))
    return rows.join(cuts, on, "left").select(*rows.columns, piece.alias(PIECE))


def scanned(rows: DataFrame, keys: str | Sequence[str], order: Sequence[str], scans: dict[str, Scan], backwards: bool = False) -> DataFrame:
    """rows (as `pieced` gives them, or any others) with a column for each scan; backwards: from the last row to the first. Equal rows in the order go by chance, so the order should tell rows apart."""
    keys = listed(keys)
    cut = PIECE in rows.columns
    way = [F.desc(o) if backwards else F.asc(o) for o in order]
    w = Window.partitionBy(*keys, *([PIECE] if cut else [])).orderBy(*way)
    frames = {True: w.rowsBetween(Window.unboundedPreceding, -1), False: w.rowsBetween(Window.unboundedPreceding, 0)}
    here = {n: _over(s.kind, s.value, frames[s.before]) for n, s in scans.items()}
    if not cut:
        return rows.select(*_others(rows, scans), *(c.alias(n) for n, c in here.items()))
    # one row for each piece of a key that has several
    place = F.struct(*(F.col(o) for o in order))
    several = rows.join(F.broadcast(rows.where(F.col(PIECE) > 0).select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi")
    ends = several.groupBy(*keys, PIECE).agg(*(_whole(s, place, backwards).alias(f"__{n}") for n, s in scans.items()))
    earlier = Window.partitionBy(*keys).orderBy(F.desc(PIECE) if backwards else F.asc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col(PIECE).alias("__k_piece"), *(_over(s.kind, F.col(f"__{n}"), earlier).alias(f"__{n}") for n, s in scans.items()))
    local = rows.select(*rows.columns, *(c.alias(f"__l_{n}") for n, c in here.items()))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    both = local.join(F.broadcast(settled(brought)), [*on, F.col(PIECE) == F.col("__k_piece")], "left")
    return both.select(*_others(rows, scans), *(_joined(s.kind, F.col(f"__{n}"), F.col(f"__l_{n}")).alias(n) for n, s in scans.items()))


def _others(rows: DataFrame, scans: dict[str, Scan]) -> list[str]:
    return [c for c in rows.columns if c not in scans]


def _over(kind: str, value: Column, window: Window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return getattr(F, kind)(value).over(window)


def _whole(s: Scan, place: Column, backwards: bool) -> Column:
    """The scan's value over all rows of a group."""
    if s.kind != "last":
        return getattr(F, s.kind)(s.value)
    return (F.min_by if backwards else F.max_by)(s.value, F.when(s.value.isNotNull(), place))


def _joined(kind: str, before: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, before)
    if kind == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    return F.least(before, here) if kind == "min" else F.greatest(before, here)
