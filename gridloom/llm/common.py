"""Shared helpers: the shared work folder, durable intermediate tables and partition counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.shared import drop_stored, new_path, remove, shared_dir, stored  # noqa: F401

TEXT_ROWS = 1000


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again, and have the driver let go of shuffle files of plans that are gone."""
    for t in tables:
        drop_stored(t)
    spark._jvm.System.gc()


def fresh(name: str, *taken: list[str]) -> str:
    """``name`` with as many underscores in front as make it unlike all taken column names in any case."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, most_bytes: int = 16_000_000) -> DataFrame:
    """``df``, a stored table, marked for broadcast if its rows take at most ``most_bytes`` together; ``row_bytes`` is what one takes.

    The size is summed up over all rows, so what is broadcast has a proven bound however long the rows are.
    """
    taken = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if taken <= most_bytes else df


def text_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers: let Arrow batches of the session have at most ``TEXT_ROWS`` rows, which bounds the workers' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run in the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    """Tasks that are worth having at once: the cores, or the shuffle partitions if they are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks(rows: int, most: int, at_least: int = 1) -> int:
    """How many blocks of at most about ``most`` rows hold ``rows`` rows."""
    return max(at_least, math.ceil(rows / most))


def slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The batches in parts of at most ``rows`` rows, so that results are handed back in small pieces."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows]
