"""The work folder that the driver and all executors share, and durable intermediate tables in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset and the session runs in one process (as in
    tests) a fresh temporary folder is made and set for the session; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The plan starts anew from files that outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for made in _SCOPES:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that were stored in each of the open scopes.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """At the end of the block all tables that were stored in it are deleted, but for those whose path was taken out of the list.

    For callers that have written what they wanted: the intermediate tables of an operator are read until its result has been.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove(spark, path)


def path_of(df: DataFrame) -> str:
    """Where a table made by :func:`stored` lies."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through the file system that it belongs to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`stored` that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)
