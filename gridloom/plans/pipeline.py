"""Whole-dataset operations from table to table: lazy plans, to be written by any sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.functions import time as times
from gridloom.operators import aggregate, combine, select


def scale(df: DataFrame, items: Sequence[str], *, factor: float = 1.0, offset: float = 0.0) -> DataFrame:
    return df.withColumns({i: nan.num(i) * float(factor) + float(offset) for i in items})


def add(a: DataFrame, b: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    return combine.binary(a, b, keys, items, "+")


def diff(a: DataFrame, b: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    return combine.binary(a, b, keys, items, "-")


def concat(tables: Sequence[DataFrame], keys: Sequence[str], *, keep: str = "last", max_gap: float | None = None) -> DataFrame:
    """Concatenation over time; with ``max_gap`` (seconds) a ValueError if two steps are further apart."""
    out = combine.concat(tables, keys, keep=keep)
    if max_gap is not None and not combine.gaps(out, max_gap).isEmpty():
        raise ValueError("there is a gap between the datasets")
    return out


def extract(df: DataFrame, *, start: int | float | str | datetime | None = None, stop: int | float | str | datetime | None = None, step: int = 1, items: Sequence[str] | None = None, keys: Sequence[str] = ("time",), time: str = "time") -> DataFrame:
    """A window of time: bounds are step numbers (int, stop inclusive, negative from the end), seconds from the start (float), or labels."""
    if isinstance(start, str) and "," in start:
        start, stop = (s.strip() or None for s in start.split(","))
    numbered = times.steps(df, time)
    first = numbered.agg(F.min(time)).first()[0] if isinstance(start, float) or isinstance(stop, float) else None
    n = numbered.count() if any(isinstance(b, int) and b < 0 for b in (start, stop)) else None
    keep = F.lit(True)
    for bound, is_stop in ((start, False), (stop, True)):
        if bound is None:
            continue
        if isinstance(bound, bool):
            raise TypeError("a bound is a number, seconds or a label")
        if isinstance(bound, int):
            at = bound + n if bound < 0 else bound
            keep = keep & ((F.col("step") <= at) if is_stop else (F.col("step") >= at))
        elif isinstance(bound, float):
            edge = times.seconds_between(times.literal(first), F.col(time))
            keep = keep & ((edge <= bound) if is_stop else (edge >= bound))
        else:
            keep = keep & (times.between(F.col(time), None, bound) if is_stop else times.between(F.col(time), bound, None))
    kept = numbered.where(keep)
    if step > 1:
        kept = kept.withColumn("_n", F.col("step") - kept.agg(F.min("step")).first()[0]).where(F.col("_n") % step == 0)
    out = df.join(kept.select(time), time, "left_semi")
    return out if items is None else out.select(*keys, *items)


def mean_time(df: DataFrame, cells: Sequence[str], items: Sequence[str], *, require_all_valid: bool = False, n_steps: int | None = None, time: str = "time") -> DataFrame:
    """The mean over time of each cell. NaN is skipped, or (``require_all_valid``) makes the cell's mean NaN."""
    if not require_all_valid:
        return aggregate.reduce(df, cells, items, "nanmean")
    n = n_steps if n_steps is not None else df.select(time).distinct().count()
    whole = lambda i: F.when(F.count(nan.valid(i)) == n, F.avg(nan.valid(i))).otherwise(F.lit(nan.NAN))
    return df.groupBy(*cells).agg(*(whole(i).alias(i) for i in items))


def quantile_time(df: DataFrame, cells: Sequence[str], items: Sequence[str], q: float | Sequence[float], *, skip_nan: bool = True) -> DataFrame:
    return aggregate.quantile(df, cells, items, q, skip_nan=skip_nan)


@dataclass(frozen=True)
class Derived:
    """A new item: a function from the columns of the items by name to a column."""

    name: str
    function: Callable[[dict[str, Column]], Column]


def transform(df: DataFrame, items: Sequence[str], derived: Sequence[Derived], *, keys: Sequence[str], keep_existing: bool = True) -> DataFrame:
    """Adds derived items; KeyError names the items that there are."""

    class Known(dict):
        def __missing__(self, name: str) -> Column:
            raise KeyError(f"no item {name!r}; there are: {', '.join(self)}")

    columns = Known({i: nan.num(i) for i in items})
    made = [d.function(columns).alias(d.name) for d in derived]
    return df.select(*keys, *(items if keep_existing else ()), *made)


def fill_corrupt(df: DataFrame, items: Sequence[str], value: float = nan.NAN) -> DataFrame:
    """Values that could not be read (null) become ``value``."""
    return df.withColumns({i: F.coalesce(F.col(i).cast("double"), F.lit(float(value))) for i in items})


def speed_and_direction(df: DataFrame, keys: Sequence[str], u: str, v: str) -> DataFrame:
    """Speed, and the direction in degrees clockwise from north towards which it goes."""
    speed = F.sqrt(nan.num(u) * nan.num(u) + nan.num(v) * nan.num(v))
    direction = nan.floor_mod(90.0 - F.degrees(F.atan2(nan.num(v), nan.num(u))), F.lit(360.0))
    return df.select(*keys, speed.alias("speed"), direction.alias("direction"))


def mean_absolute_error(model: DataFrame, observed: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """nanmean(|model - observed|) over matching keys."""
    gap = combine.binary(model, observed, keys, [item], "-")
    return gap.agg(nan.agg_nanmean(F.abs(F.col(item))).alias("mae"))


def select_items(df: DataFrame, keys: Sequence[str], wanted: str | Sequence[str]) -> DataFrame:
    return df.select(*keys, *select.match_items([c for c in df.columns if c not in keys], wanted))
