"""How far the sources of a language diverge in their use of terms, in exact integers.

Terms are counted by (language, source, term) over all whole texts, each document once per term for the document frequency. Kept terms of a
language get a sparse vector of counts by source. Terms with the same vector are one column of the audit: every ordered pair of
sources is evaluated once for each distinct vector and multiplied by the number of its terms. Terms are ranked each by itself.

With p and q the smoothed shares (in thousand millionths) of a term in two groups, the divergence is the sum of floor((p - q)^2 / q).

Null texts, languages and sources count as empty ones. A group without terms takes part; a language that keeps no term has pairs of value 0. An empty
table gives an empty one. Repeated rows are documents of their own. Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import broadcast_if_small, drop_stored, stored
from gridloom.llm.words import TERM, Tally, small_batches, strings, words

SCALE = 1_000_000_000
#: Sources whose pairs are evaluated together: a matrix of 512 KB.
BLOCK = 256
#: Matrices that a task adds up before it hands them on.
MATRICES = 64


def _named(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def numbered_groups(docs: DataFrame, *, lang: str, source: str) -> DataFrame:
    """Columns lang, source and at: all groups that occur, the sources of a language numbered from 0."""
    groups = docs.select(_named(lang).alias("lang"), _named(source).alias("source")).distinct()
    return groups.withColumn("at", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("int"))


def _if_small(groups: DataFrame) -> DataFrame:
    return broadcast_if_small(groups, F.lit(64) + F.octet_length("source") + F.octet_length("lang"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and numbers of documents by group and term, summed up within the task."""
    tally = Tally(2)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms, (n, docs) in tally.take():
            k = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), strings(terms), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = words(text, TERM)
            tally.add(0, (lang, source), found)
            tally.add(1, (lang, source), set(found))
        if tally.full():
            yield from rows()
    yield from rows()


def term_vectors(docs: DataFrame, groups: DataFrame, *, text: str, lang: str, source: str, least_docs: int) -> DataFrame:
    """Columns lang, term and vector (array of at and n, in order) of the terms in at least ``least_docs`` documents of the language.

    Counts are summed up in the tasks that read the texts; a vector has one entry for each source that uses the term.
    """
    rows = docs.select(_named(lang).alias("lang"), _named(source).alias("source"), F.col(text).cast("binary").alias("text"))
    some = rows.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long")
    counts = some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    placed = counts.join(_if_small(groups), ["lang", "source"])
    gathered = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("vector"))
    return gathered.where(F.col("docs") >= least_docs).select("lang", "term", "vector")


def _share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / whole) in decimals, which hold any product of counts."""
    top = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, whole.cast("decimal(19,0)"))


def _gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(groups: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups with ``whole``, and languages (lang, lang_whole); a whole is what shares are divided by, null if there is no kept term."""
    used = vectors.select("lang", F.explode("vector").alias("v")).groupBy("lang", F.col("v.at").alias("at")).agg(F.sum("v.n").alias("n"))
    langs = stored(vectors.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(_everywhere()).alias("all")), "languages")
    whole = groups.join(used, ["lang", "at"], "left").join(langs, "lang", "left").select("lang", "source", "at", (F.coalesce("n", F.lit(0)) + F.col("kept")).alias("whole"))
    return stored(whole, "groups"), langs.select("lang", (F.col("all") + F.col("kept")).alias("lang_whole"))


def _everywhere() -> Column:
    """The count of a term in its whole language."""
    return F.aggregate("vector", F.lit(0).cast("long"), lambda a, v: a + v["n"])


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over vectors, a block of sources by a block of sources at a time. Rows: lang, block a, block b, at, p, base, terms."""
    sums: dict[tuple, np.ndarray] = {}

    def rows() -> pd.DataFrame:
        out = []
        for (lang, a, b), m in sums.items():
            i, j = np.indices(m.shape)
            out.append(pd.DataFrame({"lang": lang, "a": (i + a * BLOCK).ravel(), "b": (j + b * BLOCK).ravel(), "value": m.ravel()}))
        sums.clear()
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})

    for pdf in batches:
        for key, part in pdf.groupby(["lang", "block_a", "block_b"], sort=False):
            base = np.asarray(part["base"].iloc[0], dtype=np.int64)
            p = np.tile(base, (len(part), 1))
            sizes = [len(x) for x in part["at"]]
            p[np.repeat(np.arange(len(part)), sizes), np.concatenate(part["at"].to_list()).astype(np.int64)] = np.concatenate(part["p"].to_list())
            terms = part["terms"].to_numpy(dtype=np.int64)
            _, a, b = key
            left, right = p[:, a * BLOCK : (a + 1) * BLOCK], p[:, b * BLOCK : (b + 1) * BLOCK]
            found = sums.setdefault(key, np.zeros((left.shape[1], right.shape[1]), dtype=np.int64))
            for j in range(right.shape[1]):
                q = right[:, j : j + 1]
                found[:, j] += ((left - q) ** 2 // q * terms[:, None]).sum(axis=0)
        if len(sums) > MATRICES:
            yield rows()
    yield rows()


def pair_divergence(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Columns lang, source, other and value for every ordered pair of sources of a language."""
    # One row for each language with as many entries as it has sources.
    langs = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "whole"))), lambda s: s["whole"]).alias("wholes"))
    langs = broadcast_if_small(stored(langs, "wholes"), F.lit(64) + F.octet_length("lang") + 8 * F.size("wholes"))
    distinct = vectors.groupBy("lang", "vector").agg(F.count("*").alias("terms")).join(langs, "lang")
    base = F.transform("wholes", lambda w: _share(F.lit(0), w))
    p = F.transform("vector", lambda v: _share(v["n"], F.get("wholes", v["at"])))
    blocks = F.sequence(F.lit(0), F.expr(f"cast((size(wholes) - 1) div {BLOCK} as int)"))
    shares = distinct.select("lang", "terms", base.alias("base"), F.transform("vector", lambda v: v["at"]).alias("at"), p.alias("p"), blocks.alias("blocks"))
    ready = shares.withColumn("block_a", F.explode("blocks")).withColumn("block_b", F.explode("blocks")).drop("blocks")
    sums = ready.mapInPandas(_pair_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    side = lambda end: groups.select("lang", F.col("source").alias(f"source_{end}"), F.col("at").alias(end))
    pairs = side("a").join(side("b"), "lang").where("a != b").join(sums, ["lang", "a", "b"], "left")
    return pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("other"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def distinctive_terms(vectors: DataFrame, groups: DataFrame, langs: DataFrame, most: int) -> DataFrame:
    """Columns lang, source, term, value and rank: the terms that a source uses more than its language does, the first ``most``."""
    used = vectors.select("lang", "term", _everywhere().alias("all"), F.explode("vector").alias("v")).select("lang", "term", "all", "v.at", "v.n")
    sized = used.join(_if_small(groups), ["lang", "at"]).join(broadcast_if_small(langs, F.lit(64) + F.octet_length("lang")), "lang")
    shares = sized.select("lang", "source", "term", _share(F.col("n"), F.col("whole")).alias("p"), _share(F.col("all"), F.col("lang_whole")).alias("q")).where("p > q")
    valued = shares.select("lang", "source", "term", _gain(F.col("p"), F.col("q")).alias("value"))
    # Spark keeps the first ``most`` of each group in every task before anything moves.
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return valued.withColumn("rank", rank).where(F.col("rank") <= most)


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """Columns lang, source, part ("pair" or "term"), item, value and rank (from 1 in each group and part)."""
    places = stored(numbered_groups(docs, lang=lang, source=source), "places")
    with small_batches(docs.sparkSession):
        vectors = stored(term_vectors(docs, places, text=text, lang=lang, source=source, least_docs=least_docs), "vectors")
    groups, langs = group_sizes(places, vectors)
    pairs = pair_divergence(vectors, groups).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "other")))
    terms = distinctive_terms(vectors, groups, langs, most_terms)
    part = lambda df, name, item: df.select("lang", "source", F.lit(name).alias("part"), F.col(item).alias("item"), "value", F.col("rank").cast("int").alias("rank"))
    out = stored(part(pairs, "pair", "other").unionByName(part(terms, "term", "term")), "divergence")
    drop_stored(vectors)
    return out
