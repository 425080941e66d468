"""Time axes: microseconds, partial-string selectors, regular grids."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_UNITS = {"us": 1, "ms": 1000, "s": 1_000_000, "min": 60_000_000, "t": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 7 * 86_400_000_000}


def micros(t: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(t) if isinstance(t, str) else t)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def period_micros(step: str | float | timedelta) -> int:
    """A step as microseconds: seconds, a timedelta, or text such as "2h", "30min", "D"."""
    if isinstance(step, timedelta):
        return step // timedelta(microseconds=1)
    if isinstance(step, str):
        found = re.fullmatch(r"\s*([0-9.]*)\s*([A-Za-z]+)\s*", step)
        if not found or found[2].lower() not in _UNITS:
            raise ValueError(f"unknown step {step!r}")
        return round(float(found[1] or 1) * _UNITS[found[2].lower()])
    return round(float(step) * 1e6)


def period_of(text: str) -> tuple[datetime, datetime]:
    """First moment of a partial time such as "2018-03", and the first one after it."""
    text = text.strip().replace("T", " ")
    parts = [int(p) for p in re.split(r"[-: ]", text.partition(".")[0])]
    begin = datetime(*(parts + [1, 1][len(parts) - 1 :] if len(parts) < 3 else parts))
    if "." in text:
        micro = int(text.partition(".")[2].ljust(6, "0")[:6])
        begin = begin.replace(microsecond=micro)
        return begin, begin + timedelta(microseconds=1)
    if len(parts) == 1:
        return begin, datetime(begin.year + 1, 1, 1)
    if len(parts) == 2:
        return begin, datetime(begin.year + begin.month // 12, begin.month % 12 + 1, 1)
    return begin, begin + {3: timedelta(days=1), 4: timedelta(hours=1), 5: timedelta(minutes=1), 6: timedelta(seconds=1)}[len(parts)]


def moment(value: str | datetime, *, end: bool = False) -> tuple[datetime, bool]:
    """A bound of a label slice and whether it belongs to the slice: ends of partial times take the whole period in."""
    if isinstance(value, datetime):
        return value, True
    begin, after = period_of(value)
    return (after, False) if end else (begin, True)


def literal(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def between(t: Column, start: str | datetime | None, stop: str | datetime | None) -> Column:
    """Whether a time lies in a label slice; both ends belong to it."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (t >= literal(moment(start)[0]))
    if stop is not None:
        last, inclusive = moment(stop, end=True)
        keep = keep & ((t <= literal(last)) if inclusive else (t < literal(last)))
    return keep


def regular(spark: SparkSession, start: datetime, stop: datetime, step: str | float | timedelta, name: str = "time") -> DataFrame:
    """All times from start to stop; the rows are made on the executors."""
    us = period_micros(step)
    if us <= 0:
        raise ValueError("the step must be positive")
    n = (stop - start) // timedelta(microseconds=us) + 1
    return spark.range(max(0, n)).select(F.timestamp_add("MICROSECOND", F.col("id") * us, literal(start)).alias(name))


def steps(df: DataFrame, time: str = "time", name: str = "step") -> DataFrame:
    """The distinct times with their number from 0, counted by range partitions: one row for each step."""
    from gridloom.operators.ordering import numbered

    return numbered(df.select(time).distinct(), [time], name)


def is_equidistant(df: DataFrame, time: str = "time") -> DataFrame:
    """One row: is_equidistant, n_steps and timestep (seconds between the first two steps; null with fewer)."""
    from gridloom.operators.ordering import with_previous

    paired = with_previous(df.select(F.col(time).alias("t")).distinct(), ["t"], ["t"])
    gaps = paired.select("t", F.timestamp_diff("MICROSECOND", F.col("_previous.t"), F.col("t")).alias("gap"))
    return gaps.agg(
        ((F.count("*") < 3) | (F.min("gap") == F.max("gap"))).alias("is_equidistant"),
        F.count("*").cast("long").alias("n_steps"),
        (F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("t"))) / 1e6).alias("timestep"),
    )


def is_monotonic(df: DataFrame, order: str, time: str = "time") -> DataFrame:
    """One row: whether times never fall along ``order``."""
    from gridloom.operators.ordering import with_previous

    paired = with_previous(df.select(F.col(order).alias("o"), F.col(time).alias("t")), ["o"], ["t"])
    return paired.agg(F.coalesce(F.min(F.timestamp_diff("MICROSECOND", F.col("_previous.t"), F.col("t"))) >= 0, F.lit(True)).alias("is_monotonic"))
