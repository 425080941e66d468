"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are cut into blocks, and every pair of blocks is one small task. In it the candidates
become postings, one list of (row, weight) for each position that holds a weight other than zero; the query rows go through
their positions one at a time and add the weighted postings to a dense array of scores. Each query's best ``k`` of the block
are selected by partition, and the blocks' results are merged by rank.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as zero beyond
their end. Repeated rows are candidates of their own; a query's own id is never among its results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import blocks

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Query rows whose scores are accumulated at once.
ROWS_AT_ONCE = 64
_NONE = np.iinfo(np.int64).min


def finite(vector: Column | str) -> Column:
    """Whether a vector is there and all its components are finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def postings(weights: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
    """(position, rows, weights) for every position that has weights; all rows are given as a slice."""
    width = max((len(w) for w in weights), default=0)
    matrix = np.zeros((len(weights), width), dtype=np.int64)
    for i, w in enumerate(weights):
        matrix[i, : len(w)] = w
    for position in range(width):
        column = np.ascontiguousarray(matrix[:, position])
        rows = np.flatnonzero(column)
        if len(rows) == len(column):
            yield position, slice(None), column
        elif len(rows):
            yield position, rows, column[rows]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id; places without a score are left out."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    at = at[scores[at] != _NONE]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_block(query_ids: np.ndarray, queries: list[np.ndarray], ids: np.ndarray, candidates: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate places, scores) of a pair of blocks."""
    terms = list(postings(candidates))
    highest = lambda rows: max((int(np.abs(w).max()) for w in rows if len(w)), default=0)
    narrow = highest(queries) * highest(candidates) * max(1, len(terms)) < 2**31
    kind = np.int32 if narrow else np.int64
    terms = [(p, rows, w.astype(kind)) for p, rows, w in terms]
    for begin in range(0, len(queries), ROWS_AT_ONCE):
        some = queries[begin : begin + ROWS_AT_ONCE]
        scores = np.zeros((len(some), len(ids)), dtype=kind)
        for position, rows, weights in terms:
            q = np.array([w[position] if position < len(w) else 0 for w in some], dtype=kind)
            users = np.flatnonzero(q)
            if isinstance(rows, slice) and len(users) == len(some):
                scores += np.multiply.outer(q, weights)
            elif len(users):
                target = np.ix_(users, np.arange(len(ids))[rows])
                scores[target] += np.multiply.outer(q[users], weights)
        for i in range(len(some)):
            row = scores[i].astype(np.int64)
            row[ids == query_ids[begin + i]] = _NONE
            at = best(ids, row, k)
            yield begin + i, at, row[at]


def top_k(vectors: DataFrame, is_query: Column, *, key: str, weights: str, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Columns query_id, rank, vec_id and score: the ``k`` rows with the highest inner product for each row with ``is_query``.

    ``weights`` is a column of array<long>. Only block counts reach the driver.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(weights).alias("w"), is_query.alias("query")).where(F.col("id").isNotNull() & F.col("w").isNotNull())
    n, n_queries = rows.agg(F.count("*"), F.count_if("query")).first()
    candidate_blocks, query_blocks = blocks(n, candidate_block), blocks(n_queries, query_block)
    block = lambda count: F.pmod(F.xxhash64("id", "w"), F.lit(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.where("query").select("id", "w", F.xxhash64("id", "w").alias("row"), block(query_blocks).alias("qb"), spread(candidate_blocks).alias("cb")).distinct()
    candidates = rows.select("id", "w", block(candidate_blocks).alias("cb"), spread(query_blocks).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = right["id"].to_numpy(dtype=np.int64)
        out = []
        for i, at, scores in search_block(left["id"].to_numpy(dtype=np.int64), left["w"].tolist(), ids, right["w"].tolist(), k):
            out.append(pd.DataFrame({"query_id": left["id"].iloc[i], "row": left["row"].iloc[i], "vec_id": ids[at], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}, dtype=np.int64)

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(search, "query_id long, row long, vec_id long, score long")
    order = W.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
