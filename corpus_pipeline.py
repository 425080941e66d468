"""A corpus pipeline of four stages: language ID, line dedup, near-dedup and packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``. :func:`run` does the same in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import language_id, line_dedup, near_dedup, packing
from gridloom.llm.common import remove, stored
from gridloom.sources.shared import scope

NEAR_PERCENT = 80
#: No SQL can express these stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go. A null language is filled in with the one that was found."""
    profiles = language_id.learn(docs.where(language_id.fold("doc_id") != 2))
    found = language_id.with_language(docs, profiles, into="_language")
    kept = found.where(F.col("_language.lang_pred") != language_id.UNDETERMINED) if profiles else found
    return kept.withColumn("lang", F.coalesce("lang", "_language.lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines only the first stays; a document without any line left goes. ``n_chars`` follows the text."""
    left = line_dedup.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return near_dedup.without_near_duplicates(docs, percent=NEAR_PERCENT).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens."""
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


STAGES = [("language_id", identify_language), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages stored on their way is deleted as soon as the next stage's rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name)
            here = made.pop()  # the stage's own rows were stored last
        if before is not None:
            remove(spark, before)
        before = here
    return docs
