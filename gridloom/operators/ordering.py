"""Dense numbers, ranks and running sums in a global order without a single task that sees all rows.

Rows are dealt to ranges of the order and sorted there; each row's place within its range is written down with it. One
row a range then carries how much lies before it. Bounds of ranges come from a sample that Spark draws, so they
differ from run to run: the dealt table is written to the shared folder before anything is counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.shared import stored

#: Ranges hold at most 2**33 rows, as Spark's own row numbers of a partition do.
_BITS = 33


def dealt(df: DataFrame, order: Sequence[Column | str], parts: int | None) -> DataFrame:
    """``df`` sorted within ranges of ``order`` with _range and _place (from 0), written down."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return stored(placed.withColumn("_range", F.shiftright("_id", _BITS)).withColumn("_place", F.col("_id") - F.shiftleft("_range", _BITS)).drop("_id"), "ordered")


def _before(totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The sums over earlier ranges; ``totals`` has one row a range, so one task orders no more than their number."""
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns))


def numbered(df: DataFrame, order: Sequence[Column | str], into: str = "number", *, start: int = 0, parts: int | None = None) -> DataFrame:
    """``df`` with a dense number (long) in ``order`` from ``start``. Rows that are equal in ``order`` get neighbouring numbers in any order."""
    sorted_ = dealt(df, order, parts)
    before = _before(sorted_.groupBy("_range").agg(F.count("*").alias("n")), ["n"])
    # One row a range.
    return sorted_.join(F.broadcast(before), "_range").withColumn(into, F.col("_place") + F.col("_before_n") + start).drop("_range", "_place", "_before_n")


def with_previous(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """``df`` with _previous, a struct of ``columns`` of the row before in ``order`` (null for the first one).

    Within a range the row before is looked up by a window; the last row of a range is carried over to the next range that has rows.
    """
    sorted_ = dealt(df, order, parts)
    last = sorted_.groupBy("_range").agg(F.max_by(F.struct(*columns), "_place").alias("_last"))
    carried = last.select("_range", F.lag("_last").over(W.orderBy("_range")).alias("_carried"))
    inside = sorted_.withColumn("_own", F.lag(F.struct(*columns)).over(W.partitionBy("_range").orderBy("_place")))
    return inside.join(F.broadcast(carried), "_range").withColumn("_previous", F.when(F.col("_place") > 0, F.col("_own")).otherwise(F.col("_carried"))).drop("_own", "_carried", "_range", "_place")


def running_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], *, parts: int | None = None) -> DataFrame:
    """``df`` with running sums in ``order``, the row itself included; ``sums`` has the name of each and what is summed."""
    named = {f"_s{i}": c for i, c in enumerate(sums.values())}
    sorted_ = dealt(df.withColumns(named), order, parts)
    before = _before(sorted_.groupBy("_range").agg(*(F.sum(c).alias(c) for c in named)), list(named))
    so_far = W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    joined = sorted_.withColumns({f"_in{c}": F.sum(c).over(so_far) for c in named}).join(F.broadcast(before), "_range")
    out = {name: F.col(f"_in{c}") + F.col(f"_before_{c}") for name, c in zip(sums, named, strict=True)}
    return joined.withColumns(out).drop("_range", "_place", *named, *(f"_in{c}" for c in named), *(f"_before_{c}" for c in named))
