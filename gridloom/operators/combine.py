"""Arithmetic between datasets, merging of items, concatenation over time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import nan

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: nan.num(a) + nan.num(b), "-": lambda a, b: nan.num(a) - nan.num(b), "*": lambda a, b: nan.num(a) * nan.num(b),
    "/": nan.divide, "//": nan.floor_divide, "%": nan.floor_mod, "**": nan.power,
    "<": nan.less, "<=": nan.less_equal, ">": nan.greater, ">=": nan.greater_equal, "==": nan.equal, "!=": nan.not_equal,
}


def scalar(df: DataFrame, items: Sequence[str], operator: str, value: float, *, swapped: bool = False) -> DataFrame:
    op, v = BINARY[operator], F.lit(float(value))
    return df.withColumns({i: op(v, F.col(i)) if swapped else op(F.col(i), v) for i in items})


def unary(df: DataFrame, items: Sequence[str], how: str) -> DataFrame:
    f = {"-": lambda c: -c, "+": lambda c: c, "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp}[how]
    return df.withColumns({i: f(nan.num(i)) for i in items})


def binary(left: DataFrame, right: DataFrame, keys: Sequence[str], items: Sequence[str], operator: str, other_items: Sequence[str] | None = None) -> DataFrame:
    """Items of two tables by position, rows matched on ``keys`` (those that the right side has)."""
    other_items = list(other_items or items)
    if len(other_items) not in (1, len(items)):
        raise ValueError("both sides need as many items, or the right side one")
    if len(other_items) == 1:
        other_items = other_items * len(items)
    on = [k for k in keys if k in right.columns]
    named = right.select(*on, *(F.col(o).alias(f"_r{n}") for n, o in enumerate(other_items)))
    op = BINARY[operator]
    return left.join(named, on).select(*keys, *(op(F.col(i), F.col(f"_r{n}")).alias(i) for n, i in enumerate(items)))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """Whether both have the same key rows (an action)."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The items of several tables side by side; ValueError if a name occurs twice."""
    names = [c for t in tables for c in t.columns if c not in keys]
    if len(set(names)) < len(names):
        raise ValueError(f"items with the same name: {sorted({n for n in names if names.count(n) > 1})}")
    return reduce(lambda a, b: a.join(b, list(keys)), tables)


def concat(tables: Sequence[DataFrame], keys: Sequence[str], *, keep: str = "last") -> DataFrame:
    """The union over time. Where a key occurs in several tables the first or last one counts, or the average."""
    items = [c for c in tables[0].columns if c not in keys]
    tagged = [t.select(*keys, *items, F.lit(n).alias("_source")) for n, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    if keep == "average":
        return every.groupBy(*keys).agg(*(nan.agg_mean(F.col(i)).alias(i) for i in items))
    if keep not in ("first", "last"):
        raise ValueError(f"keep is first, last or average, not {keep!r}")
    pick = F.max_by if keep == "last" else F.min_by
    row = every.groupBy(*keys).agg(pick(F.struct(*items), F.col("_source")).alias("_row"))
    return row.select(*keys, *(F.col("_row")[i].alias(i) for i in items))


def has_duplicate_times(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key occurs twice (an action)."""
    return not df.groupBy(*keys).count().where("count > 1").isEmpty()


def gaps(df: DataFrame, seconds: float, time: str = "time") -> DataFrame:
    """Places where the next time step is more than ``seconds`` away: time, next_time, gap."""
    from gridloom.functions.time import seconds_between, steps

    numbered = steps(df, time).withColumn("next_time", F.lead(time).over(W.orderBy(time)))
    gap = seconds_between(F.col(time), F.col("next_time"))
    return numbered.select(time, "next_time", gap.alias("gap")).where(F.col("gap") > seconds)
