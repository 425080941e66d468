"""Reductions over time, space or items. Grouping keys are the dimensions that stay."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import nan


def reduce(df: DataFrame, keys: Sequence[str], items: Sequence[str], how: str | Callable[[Column], Column], *, time: str | None = None) -> DataFrame:
    """One aggregate of every item. ``time``: a dimension that is reduced but keeps its first stamp."""
    agg = nan.AGGREGATES[how] if isinstance(how, str) else how
    columns = [agg(F.col(i)).alias(i) for i in items]
    if time:
        columns = [F.min(time).alias(time), *columns]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def reduce_with(df: DataFrame, keys: Sequence[str], items: Sequence[str], function: Callable[[pd.Series], float]) -> DataFrame:
    """Any function of the values of a group; for what no built-in aggregate can express. A group has to fit a task."""

    @F.pandas_udf("double")
    def call(values: pd.Series) -> float:
        return float(function(values))

    return df.groupBy(*keys).agg(*(call(nan.num(i)).alias(i) for i in items))


#: Values of one group that one task may hold for its exact quantiles (some 100 MB); larger groups are ranked by range partitions.
MOST_IN_TASK = 2_000_000


def quantile(df: DataFrame, keys: Sequence[str], items: Sequence[str], q: float | Sequence[float], *, skip_nan: bool = False, most_in_task: int | None = MOST_IN_TASK) -> DataFrame:
    """Exact quantiles; a list gives one column for each, named "Quantile q, item".

    The largest group is counted first. Where it has more than ``most_in_task`` rows, values are ranked by range partitions (:func:`ranked`), which gives
    the same values in bounded memory. None leaves the count out.
    """
    one = isinstance(q, (int, float))
    qs = [q] if one else list(q)
    named = lambda i, v: i if one else f"Quantile {v}, {i}"
    if most_in_task is not None and _largest(df, keys) > most_in_task:
        found = ranked(df, keys, items, qs)
        value = lambda n, k: F.when(F.col(f"_bad{n}") > 0, F.lit(nan.NAN)).otherwise(nan.or_nan(F.col(f"_q{n}_{k}"))) if not skip_nan else nan.or_nan(F.col(f"_q{n}_{k}"))
        return found.select(*keys, *(value(n, k).alias(named(i, v)) for k, v in enumerate(qs) for n, i in enumerate(items)))
    agg = nan.agg_nanquantile if skip_nan else nan.agg_quantile
    columns = [agg(F.col(i), v).alias(named(i, v)) for v in qs for i in items]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def _largest(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def ranked(df: DataFrame, keys: Sequence[str], items: Sequence[str], qs: Sequence[float], *, parts: int | None = None) -> DataFrame:
    """``keys`` and for item n and quantile k a column _q<n>_<k> over the values that aren't NaN, with _n<n> (their number) and _bad<n> (that of NaN).

    All values are sorted into ranges of (keys, item, value), which spill and never hold a whole group. Counts by range say in which range, and at which place in
    it, a wanted rank lies; only these rows are then picked out of the sorted table.
    """
    from pyspark.sql import Window as W

    from gridloom.operators.ordering import dealt

    names = [f"_k{j}" for j in range(len(keys))]
    long = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.explode(F.array(*(F.struct(F.lit(n).alias("_item"), nan.num(i).alias("_v")) for n, i in enumerate(items)))).alias("_e")).select(*names, "_e.*")
    counts = long.groupBy(*names, "_item").agg(F.count_if(~F.isnan("_v")).alias("n"), F.count_if(F.isnan("_v")).alias("bad"))
    table = dealt(long.where(~F.isnan("_v")), [*names, "_item", "_v"], parts)
    spans = table.groupBy(*names, "_item", "_range").agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    group = W.partitionBy(*names, "_item")  # a group has a row for each range that it reaches into
    placed = spans.withColumn("before", F.coalesce(F.sum("n").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(group))
    low = lambda q: F.floor((F.col("total") - 1) * F.lit(float(q)))
    asked = [F.struct(F.lit(k).alias("q"), F.lit(side).alias("side"), F.least(low(q) + side, F.col("total") - 1).alias("rank"), ((F.col("total") - 1) * F.lit(float(q)) - low(q)).alias("share")) for k, q in enumerate(qs) for side in (0, 1)]
    wanted = placed.withColumn("_a", F.explode(F.array(*asked))).where((F.col("_a.rank") >= F.col("before")) & (F.col("_a.rank") < F.col("before") + F.col("n")))
    wanted = wanted.select("_range", (F.col("first") + F.col("_a.rank") - F.col("before")).alias("_place"), "_a.q", "_a.side", "_a.share")
    hits = table.join(wanted, ["_range", "_place"])
    pairs = hits.groupBy(*names, "_item", "q", "share").agg(F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("b"))
    # As Spark's own percentile weighs the two.
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"))
    pick = lambda n, k: F.max(F.when((F.col("_item") == n) & (F.col("q") == k), F.col("value"))).alias(f"_q{n}_{k}")
    wide = pairs.withColumn("value", value).groupBy(*names).agg(*(pick(n, k) for n in range(len(items)) for k in range(len(qs))))
    of = lambda n, c: F.max(F.when(F.col("_item") == n, F.col(c)))
    sizes = counts.groupBy(*names).agg(*(x for n in range(len(items)) for x in (of(n, "n").alias(f"_n{n}"), of(n, "bad").alias(f"_bad{n}"))))
    if names:
        same = [sizes[n].eqNullSafe(wide[n]) for n in names]
        joined = sizes.join(wide, same, "left").select(*(sizes[n].alias(k) for n, k in zip(names, keys, strict=True)), *(c for c in (*sizes.columns, *wide.columns) if c not in names))
        return joined
    return sizes.join(F.broadcast(wide))  # one row each


def average(df: DataFrame, keys: Sequence[str], items: Sequence[str], weights: Column | str) -> DataFrame:
    w = F.col(weights) if isinstance(weights, str) else weights
    columns = [nan.agg_average(F.col(i), w).alias(i) for i in items]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def across_items(df: DataFrame, keys: Sequence[str], items: Sequence[str], how: str, into: str | None = None) -> DataFrame:
    """An aggregate over the items of each row."""
    return df.select(*keys, nan.row_reduce([F.col(i) for i in items], how).alias(into or how))


def quantile_across_items(df: DataFrame, keys: Sequence[str], items: Sequence[str], q: float, *, skip_nan: bool = False) -> DataFrame:
    return df.select(*keys, nan.row_quantile([F.col(i) for i in items], q, skip_nan=skip_nan).alias(f"Quantile {q}"))


def describe(df: DataFrame, items: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75), *, most_in_task: int | None = MOST_IN_TASK) -> DataFrame:
    """A row for each item: count, mean, std (sample), min, percentiles and max over all values that are not NaN.

    All items are worked out in one pass; percentiles of more than ``most_in_task`` rows by range partitions.
    """
    large = most_in_task is not None and _largest(df, []) > most_in_task
    fields = []
    for n, i in enumerate(items):
        v = nan.valid(i)
        stats = {"count": F.count(v).cast("double"), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v)}
        if not large:
            stats |= {f"{100 * p:g}%": F.percentile(v, F.lit(float(p))) for p in percentiles}
        stats |= {"max": F.max(v)}
        fields.append(F.struct(F.lit(i).alias("item"), *(nan.or_nan(c).alias(k) for k, c in stats.items())))
    done = df.agg(F.array(*fields).alias("_all")).select(F.inline("_all"))
    if not large:
        return done
    found = ranked(df, [], items, percentiles)
    rows = F.array(*(F.struct(F.lit(i).alias("item"), *(nan.or_nan(F.col(f"_q{n}_{k}")).alias(f"{100 * p:g}%") for k, p in enumerate(percentiles))) for n, i in enumerate(items)))
    return done.join(found.select(F.inline(rows)), "item").select("item", "count", "mean", "std", "min", *(f"{100 * p:g}%" for p in percentiles), "max")


def histogram(df: DataFrame, item: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0) and n; values outside and NaN don't count, the upper edge belongs to the last bin."""
    v = nan.valid(item)
    at = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def rolling(df: DataFrame, keys: Sequence[str], items: Sequence[str], time: str, seconds: float, how: str = "nanmean") -> DataFrame:
    """An aggregate over the last ``seconds`` before and at each row, within each of ``keys``."""
    from pyspark.sql import Window as W

    from gridloom.functions.time import micros

    w = W.partitionBy(*keys).orderBy("_us").rangeBetween(-round(seconds * 1e6), 0)
    plain = {"nanmean": F.avg, "nanmax": F.max, "nanmin": F.min, "nansum": F.sum}[how]
    timed = df.withColumn("_us", micros(time))
    return timed.select(*keys, time, *(nan.or_nan(plain(nan.valid(i)).over(w)).alias(i) for i in items))


def exceedance(df: DataFrame, keys: Sequence[str], items: Sequence[str], threshold: float) -> DataFrame:
    """The share of valid values above a threshold."""
    columns = [nan.or_nan(F.avg((nan.valid(i) > threshold).cast("double"))).alias(i) for i in items]
    return df.groupBy(*keys).agg(*columns)
