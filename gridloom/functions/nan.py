"""Arithmetic, comparisons and aggregates with IEEE rules for NaN and zero.

NaN is the missing value; a null counts as NaN. All functions take and return Columns, so they stay inside
whole-stage code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def num(c: Column | str | float) -> Column:
    """A double without nulls."""
    c = F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))
    return F.coalesce(c.cast("double"), F.lit(NAN))


def valid(c: Column | str) -> Column:
    """Null instead of NaN, for aggregates that are to skip it."""
    return F.nanvl(num(c), F.lit(None).cast("double"))


def or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


# arithmetic


def divide(a: Column, b: Column) -> Column:
    """a / b with inf and NaN for a zero divisor (-0.0 counts as 0.0)."""
    a, b = num(a), num(b)
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def floor_divide(a: Column, b: Column) -> Column:
    """The floor of a / b as a double; quotients beyond 9e15 are whole already."""
    q = divide(a, b)
    return F.when(F.isnan(q) | (F.abs(q) >= 9e15), q).otherwise(F.floor(q).cast("double"))


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor."""
    a, b = num(a), num(b)
    divisor = F.when(b == 0, F.lit(NAN)).otherwise(b)
    r = a % divisor
    return F.when((r != 0) & ~F.isnan(r) & ((r < 0) != (divisor < 0)), r + divisor).otherwise(r)


def power(a: Column, b: Column) -> Column:
    return F.pow(num(a), num(b))


# comparisons: false with NaN, but for "not equal"


def less(a: Column, b: Column) -> Column:
    a, b = num(a), num(b)
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def less_equal(a: Column, b: Column) -> Column:
    a, b = num(a), num(b)
    return ~F.isnan(a) & ~F.isnan(b) & (a <= b)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def greater_equal(a: Column, b: Column) -> Column:
    return less_equal(b, a)


def equal(a: Column, b: Column) -> Column:
    a, b = num(a), num(b)
    return ~F.isnan(a) & (a == b)


def not_equal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


# aggregates


def _guard(v: Column, c: Column) -> Column:
    return F.when(F.bool_or(F.isnan(v)), F.lit(NAN)).otherwise(c)


def agg_max(v: Column) -> Column:
    return F.max(num(v))


def agg_min(v: Column) -> Column:
    return _guard(num(v), F.min(num(v)))


def agg_mean(v: Column) -> Column:
    return F.avg(num(v))


def agg_std(v: Column) -> Column:
    return F.stddev_pop(num(v))


def agg_sum(v: Column) -> Column:
    return F.sum(num(v))


def agg_ptp(v: Column) -> Column:
    return _guard(num(v), F.max(num(v)) - F.min(num(v)))


def agg_nanmax(v: Column) -> Column:
    return or_nan(F.max(valid(v)))


def agg_nanmin(v: Column) -> Column:
    return or_nan(F.min(valid(v)))


def agg_nanmean(v: Column) -> Column:
    return or_nan(F.avg(valid(v)))


def agg_nanstd(v: Column) -> Column:
    return or_nan(F.stddev_pop(valid(v)))


def agg_average(v: Column, w: Column) -> Column:
    """The mean with weights."""
    return divide(F.sum(num(v) * num(w)), F.sum(num(w)))


def agg_quantile(v: Column, q: float) -> Column:
    """Exact, with linear interpolation."""
    return _guard(num(v), F.percentile(num(v), F.lit(float(q))))


def agg_nanquantile(v: Column, q: float) -> Column:
    return or_nan(F.percentile(valid(v), F.lit(float(q))))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "max": agg_max, "min": agg_min, "mean": agg_mean, "std": agg_std, "ptp": agg_ptp, "sum": agg_sum,
    "nanmax": agg_nanmax, "nanmin": agg_nanmin, "nanmean": agg_nanmean, "nanstd": agg_nanstd,
}


# across items of one row


def row_reduce(values: Sequence[Column], how: str) -> Column:
    """An aggregate over the items of a row."""
    values = [num(v) for v in values]
    any_nan = values[0] != values[0]
    for v in values:
        any_nan = any_nan | F.isnan(v)
    total = sum(values[1:], values[0])
    mean = total / float(len(values))
    array = F.array(*[valid(v) for v in values])
    kept = F.filter(array, lambda x: x.isNotNull())
    n = F.size(kept).cast("double")
    kept_sum = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    kept_mean = divide(kept_sum, n)
    if how == "mean":
        return mean
    if how == "sum":
        return total
    if how == "max":
        return F.greatest(*values) if len(values) > 1 else values[0]
    if how == "min":
        return F.when(any_nan, F.lit(NAN)).otherwise(F.least(*values) if len(values) > 1 else values[0])
    if how == "ptp":
        return row_reduce(values, "max") - row_reduce(values, "min")
    if how == "std":
        squares = [(v - mean) * (v - mean) for v in values]
        return F.sqrt(sum(squares[1:], squares[0]) / float(len(values)))
    if how == "nanmax":
        return or_nan(F.array_max(kept))
    if how == "nanmin":
        return or_nan(F.array_min(kept))
    if how == "nanmean":
        return kept_mean
    if how == "nanstd":
        return F.sqrt(divide(F.aggregate(F.transform(kept, lambda x: (x - kept_mean) * (x - kept_mean)), F.lit(0.0), lambda acc, x: acc + x), n))
    raise ValueError(f"unknown aggregate {how!r}")


def row_quantile(values: Sequence[Column], q: float, *, skip_nan: bool = False) -> Column:
    """A quantile over the items of a row, with linear interpolation."""
    array = F.array_sort(F.filter(F.array(*[valid(v) for v in values]), lambda x: x.isNotNull()))
    n = F.size(array)
    at = (n - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(array, low), F.get(array, F.least(low + 1, n - 1))
    found = or_nan(F.when(n > 0, a + (b - a) * (at - low)))
    return found if skip_nan else F.when(n < len(values), F.lit(NAN)).otherwise(found)
