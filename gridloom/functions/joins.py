"""Joins between tables that both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is dealt by its keys, never sent whole through the driver.

    Spark estimates a table by the compressed size of its files. A few megabytes of regular keys hold millions of rows, and more once
    lists are exploded, so that it would broadcast what the driver can't hold.
    """
    return df.hint("merge")
