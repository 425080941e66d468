"""Planar and geographic distances as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The earth radius in metres for distances, and for areas.
EARTH_RADIUS, EARTH_RADIUS_AREA = 6_371_000.0, 6_366_707.0


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def geographic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on an equirectangular projection at the mean latitude; longitudes wrap at the date line."""
    step = F.abs(lon1 - lon2)
    step = F.when(step > 180, 360 - step).otherwise(step)
    x = F.radians(step) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat1 - lat2)
    return EARTH_RADIUS * F.sqrt(x * x + y * y)


def distance(x1: Column, y1: Column, x2: Column, y2: Column, *, is_geo: bool = False) -> Column:
    return geographic(x1, y1, x2, y2) if is_geo else planar(x1, y1, x2, y2)


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def cumulative(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, *, is_geo: bool = False, into: str = "distance") -> DataFrame:
    """The length of the path so far, for each of ``keys``."""
    w = W.partitionBy(*keys).orderBy(order)
    step = distance(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y), is_geo=is_geo)
    stepped = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn(into, F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def bounds(df: DataFrame, x: str, y: str, buffer: float = 0.0) -> DataFrame:
    """One row: left, bottom, right, top."""
    return df.agg((F.min(x) - buffer).alias("left"), (F.min(y) - buffer).alias("bottom"), (F.max(x) + buffer).alias("right"), (F.max(y) + buffer).alias("top"))


def to_wkt(x: Column, y: Column, z: Column | None = None) -> Column:
    parts = [x, y] if z is None else [x, y, z]
    return F.concat(F.lit("POINT (" if z is None else "POINT Z ("), F.concat_ws(" ", *(p.cast("string") for p in parts)), F.lit(")"))
