"""Wave spectra: moments and the significant wave height."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.geometry.spectrum import bin_widths


def with_widths(df: DataFrame, frequencies: Sequence[float], index: str = "frequency_idx") -> DataFrame:
    """Adds frequency and width by the index of the bin; the axis is a literal array, so nothing is joined."""
    f = F.array(*(F.lit(float(x)) for x in frequencies))
    w = F.array(*(F.lit(float(x)) for x in bin_widths(frequencies)))
    return df.withColumn("frequency", F.get(f, F.col(index))).withColumn("width", F.get(w, F.col(index)))


def zeroth_moment(df: DataFrame, keys: Sequence[str], energy: str, *, direction_step: float | None = None, tail: bool = True) -> DataFrame:
    """m0 of each of ``keys``: the sum over directions and frequencies, and the tail beyond the last frequency.

    ``df`` has frequency and width. ``direction_step`` is in degrees; None for spectra without directions.
    """
    step = 1.0 if direction_step is None else math.radians(direction_step)
    by_f = df.groupBy(*keys, "frequency", "width").agg((F.sum(nan.num(energy)) * step).alias("_e"))
    m0 = F.sum(F.col("_e") * F.col("width"))
    if tail:
        last = F.max(F.struct("frequency", "_e"))
        m0 = m0 + last["_e"] * last["frequency"] * 0.25
    return by_f.groupBy(*keys).agg(m0.alias("m0"))


def significant_wave_height(df: DataFrame, keys: Sequence[str], energy: str, *, direction_step: float | None = None, tail: bool = True) -> DataFrame:
    """Hm0 = 4 sqrt(m0)."""
    return zeroth_moment(df, keys, energy, direction_step=direction_step, tail=tail).select(*keys, (4 * F.sqrt("m0")).alias("Hm0"))
