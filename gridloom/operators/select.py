"""Selections: items, time steps, cells, masks. They become projections and filters that reach the scan."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.functions import time as times
from gridloom.items import ItemsError


def match_items(known: Sequence[str], wanted: str | int | Sequence[str | int] | None) -> list[str]:
    """Names by name, number or wildcard, in the order in which they are wanted; ItemsError if one is unknown."""
    if wanted is None:
        return list(known)
    out: list[str] = []
    for w in [wanted] if isinstance(wanted, (str, int)) else wanted:
        if isinstance(w, int):
            if not -len(known) <= w < len(known):
                raise ItemsError(w, known)
            found = [known[w]]
        elif w in known:
            found = [w]
        else:
            found = fnmatch.filter(known, w) if any(c in w for c in "*?[") else []
        if not found:
            raise ItemsError(w, known)
        out += [f for f in found if f not in out]
    return out


def steps_at(df: DataFrame, steps: int | slice | Sequence[int], time: str = "time", *, n_steps: int | None = None) -> DataFrame:
    """Rows of time steps by number: an integer, a slice, or a list; negative numbers count from the end, IndexError beyond it.

    Steps are the distinct times in order. Rows are a set, so a slice with a negative step takes the same steps as the one that is walked the other way.
    """
    numbered = times.steps(df, time)
    wanted = places(steps, n_steps if n_steps is not None else numbered.count(), "time")
    if isinstance(wanted, range):
        low, high = (min(wanted), max(wanted)) if len(wanted) else (0, -1)
        keep = F.col("step").between(low, high) & ((F.col("step") - low) % abs(wanted.step) == 0)
    else:
        keep = F.col("step").isin(wanted)
    return df.join(numbered.where(keep).select(time), time, "left_semi")


def places(at: int | slice | Sequence[int], n: int, name: str = "axis") -> list[int] | range:
    """The numbers that an index stands for on an axis of ``n`` cells; negative ones count from the end, IndexError beyond it."""
    if isinstance(at, slice):
        return range(n)[at]
    wanted = [at] if isinstance(at, int) else [int(i) for i in at]
    for i in wanted:
        if not -n <= i < n:
            raise IndexError(f"{name} has {n} places, {i} is outside")
    return [i % n for i in wanted]


def cells_at(df: DataFrame, column: str, wanted: list[int] | range, *, anew: bool = True) -> DataFrame:
    """Rows of some cells. With ``anew`` the cells are numbered from 0 in the order in which they are wanted."""
    if isinstance(wanted, range):
        if not len(wanted):
            return df.limit(0)
        low, high = min(wanted[0], wanted[-1]), max(wanted[0], wanted[-1])
        at = F.col(column) - wanted.start
        kept = df.where(F.col(column).between(low, high) & (at % abs(wanted.step) == 0))
        return kept.withColumn(column, F.floor(at / wanted.step).cast("int")) if anew else kept
    table = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(wanted)], "_cell int, _place int")
    kept = df.join(F.broadcast(table), df[column] == table["_cell"])  # as long as the list that the caller wrote
    return (kept.withColumn(column, F.col("_place")) if anew else kept).drop("_cell", "_place")


def last_step(df: DataFrame, time: str = "time") -> DataFrame:
    return df.join(df.agg(F.max(time).alias(time)), time, "left_semi")


def time_slice(df: DataFrame, start: str | datetime | None = None, stop: str | datetime | None = None, time: str = "time") -> DataFrame:
    """Rows between two labels, both inclusive; a partial label stands for its whole period. The filter is pushed down."""
    return df.where(times.between(F.col(time), start, stop))


def at_time(df: DataFrame, label: str | datetime, time: str = "time") -> DataFrame:
    """Rows of one label: a partial one takes its whole period."""
    return time_slice(df, label, label, time)


def in_box(df: DataFrame, box: Sequence[float], x: str = "x", y: str = "y") -> DataFrame:
    left, bottom, right, top = box
    return df.where(F.col(x).between(left, right) & F.col(y).between(bottom, top))


def inside_polygon(x: Column, y: Column, polygon: Sequence[Sequence[float]]) -> Column:
    """Whether a point lies in a polygon, by the even-odd rule; no join, one expression for each edge."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def nearest_cell(df: DataFrame, at: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """The rows of the cell nearest to a point; the first by key in a tie."""
    square = sum(((F.col(d) - x) * (F.col(d) - x) for d, x in at.items()), F.lit(0.0))
    cells = df.select(*keys, square.alias("_d")).distinct()
    best = cells.agg(F.min(F.struct("_d", *keys)).alias("best")).select(*(F.col(f"best.{k}").alias(k) for k in keys))
    return df.join(F.broadcast(best), list(keys), "left_semi")  # one row


def where(df: DataFrame, items: Sequence[str], mask: Column, value: Column | float = nan.NAN) -> DataFrame:
    """Items take ``value`` where the mask holds."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    return df.withColumns({i: F.when(mask, value).otherwise(F.col(i)) for i in items})


def fillna(df: DataFrame, items: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({i: F.nanvl(nan.num(i), F.lit(float(value))) for i in items})


def dropna(df: DataFrame, items: Sequence[str], time: str = "time") -> DataFrame:
    """Rows of the time steps at which each item has a value in some cell."""
    has = df.groupBy(time).agg(*(F.count(nan.valid(i)).alias(f"_{n}") for n, i in enumerate(items)))
    keep = has.where(" and ".join(f"_{n} > 0" for n in range(len(items)))).select(time)
    return df.join(keep, time, "left_semi")


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Items keep their places."""
    return df.withColumnsRenamed(names)
