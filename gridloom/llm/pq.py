"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, exact cosine rerank.

Equal vectors form one class. Unit vectors are put into coarse lists and their residuals are coded in subspaces. Every class
probes its nearest lists: table-lookup distances from the query to the coded vectors, less the stored error of each code,
are a lower bound of the true distance, so what they drop can't be a link; the rest is compared exactly in
double precision. Only a list that isn't probed can cost a link, and a pair counts if either side probes the other.

Lists are cut into blocks, so a hot list is many tasks. A task returns the number of links of each class and a spanning
forest of the links it found, never the pairs. Vectors that are null, zero, or hold null or non-finite components link with
nothing; shorter vectors count as zero beyond their end. Repeated rows and ids are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, stored
from gridloom.llm.components import components, spanning_forest
from gridloom.llm.top_k import finite

#: The index is fitted on at most about this many classes, drawn by hash; every row is indexed.
SAMPLE_ROWS = 20_000
ROWS_A_LIST, MOST_LISTS, PROBES = 200, 2048, 8
SUBSPACES, CODEWORDS, ITERATIONS = 8, 64, 6
BLOCK = 2048


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    codewords: np.ndarray  # (subspaces, codewords, dimensions of a subspace)

    @property
    def width(self) -> int:
        return self.codewords.shape[0] * self.codewords.shape[2]

    def unit(self, vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def residual_parts(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return (unit - self.centroids[lists]).reshape(len(unit), *self.codewords.shape[::2])

    def probes(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        near = np.sum(self.centroids**2, axis=1) - 2 * unit @ self.centroids.T
        return np.argsort(near, axis=1, kind="stable")[:, :most].astype(np.int32)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code for each subspace, and the distance from the vector to what the codes stand for."""
        parts = self.residual_parts(unit, lists)
        codes = np.stack([nearest(parts[:, m], self.codewords[m]) for m in range(len(self.codewords))], axis=1)
        error = parts - self.codewords[np.arange(len(self.codewords)), codes]
        return codes.astype(np.uint8), np.sqrt(np.sum(error**2, axis=(1, 2)))

    def table_distances(self, unit: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances from queries to coded vectors of one list, by a table for each subspace."""
        parts = self.residual_parts(unit, np.full(len(unit), which))
        total = np.zeros((len(unit), len(codes)), dtype=np.float32)
        for m, words in enumerate(self.codewords):
            table = np.sum(parts[:, m] ** 2, axis=1)[:, None] + np.sum(words**2, axis=1) - 2 * parts[:, m] @ words.T
            total += table.astype(np.float32)[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.sum(centres**2, axis=1) - 2 * points @ centres.T, axis=1)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ITERATIONS):
        owner = nearest(points, centres)
        count = np.bincount(owner, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, owner, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def fit(sample: list, lists: int, seed: int = 7) -> Index:
    """An index fitted on sample vectors, on one machine."""
    rng = np.random.default_rng(seed)
    width = -(-max(len(v) for v in sample) // SUBSPACES) * SUBSPACES
    points = Index(np.zeros((1, width)), np.zeros((SUBSPACES, 1, width // SUBSPACES))).unit(sample)
    centroids = k_means(points, lists, rng)
    parts = (points - centroids[nearest(points, centroids)]).reshape(len(points), SUBSPACES, -1)
    words = [k_means(parts[:, m], CODEWORDS, rng) for m in range(SUBSPACES)]
    return Index(centroids, np.stack(words))


def compare_block(index: Index, which: int, queries: pd.DataFrame, candidates: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Columns a, b, n: links that a class has more (b null), or two classes that are connected (n null)."""
    x, y = index.unit(queries["vector"].tolist()), index.unit(candidates["vector"].tolist())
    codes = np.frombuffer(b"".join(candidates["codes"]), dtype=np.uint8).reshape(len(candidates), -1)
    bound = np.sqrt(2 - 2 * cosine) + 1e-3
    maybe = index.table_distances(x, which, codes) - candidates["error"].to_numpy(dtype=np.float32) <= bound
    x_ids, y_ids = queries["cid"].to_numpy(), candidates["cid"].to_numpy()
    nodes, number = np.unique(np.concatenate([x_ids, y_ids]), return_inverse=True)
    x_node, y_node = number[: len(x)], number[len(x) :]
    rows, cols = np.nonzero(maybe)
    # Sums in one order whatever the block, so that a pair at the bound is judged alike wherever it is compared.
    same = np.concatenate([np.zeros(0, dtype=bool), *(np.einsum("ij,ij->i", x[rows[i : i + 50_000]], y[cols[i : i + 50_000]]) >= cosine for i in range(0, len(rows), 50_000))])
    rows, cols = rows[same], cols[same]
    other = x_node[rows] != y_node[cols]
    rows, cols = rows[other], cols[other]
    # The other side finds the pair by itself if it probes the query's list.
    homes, home = np.unique(queries["home"].to_numpy(), return_inverse=True)
    y_probes = np.stack(candidates["probes"].tolist()) if len(candidates) else np.zeros((0, 1))
    probed = np.stack([(y_probes == h).any(axis=1) for h in homes])
    alone = ~probed[home[rows], cols]
    x_copies, y_copies = queries["copies"].to_numpy(), candidates["copies"].to_numpy()
    n = np.zeros(len(nodes), dtype=np.int64)
    n += np.bincount(x_node[rows], weights=y_copies[cols], minlength=len(nodes)).astype(np.int64)
    n += np.bincount(y_node[cols[alone]], weights=x_copies[rows[alone]], minlength=len(nodes)).astype(np.int64)
    root = spanning_forest(x_node[rows], y_node[cols], len(nodes))
    counted, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(nodes)))
    counts = pd.DataFrame({"a": nodes[counted], "b": None, "n": pd.array(n[counted], dtype="Int64")})
    forest = pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]], "n": pd.array([None] * len(moved), dtype="Int64")})
    return pd.concat([counts, forest]).astype({"a": object, "b": object})


def linked_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``key``, n_links (other rows linked directly), component_id (smallest id reachable) and kept."""
    ok = finite(F.col(vector)) & F.exists(F.col(vector), lambda x: x != 0)
    cid = F.concat_ws(":", F.xxhash64(F.col(vector)), F.xxhash64(F.lit(1), F.col(vector)))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.when(F.coalesce(ok, F.lit(False)), cid).alias("cid"))
    classes = rows.where("cid is not null").groupBy("cid", "vector").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    n = classes.count()
    if not n:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1.0, SAMPLE_ROWS / n)
    drawn = classes.where(F.pmod(F.xxhash64(F.lit("sample"), "cid"), F.lit(1_000_000)) < share * 1_000_000).select("vector").limit(2 * SAMPLE_ROWS)
    sample = [r["vector"] for r in drawn.collect()] or [classes.first()["vector"]]
    index = fit(sample, min(MOST_LISTS, max(1, n // ROWS_A_LIST)))

    def put(batches):
        for pdf in batches:
            unit = index.unit(pdf["vector"].tolist())
            near = index.probes(unit, probes)
            codes, error = index.encode(unit, near[:, 0])
            yield pdf.assign(home=near[:, 0], probes=list(near), codes=[c.tobytes() for c in codes], error=error.astype(np.float32))

    kind = dict(classes.dtypes)["vector"]
    indexed = stored(classes.select("cid", "vector", "copies").mapInPandas(put, f"cid string, vector {kind}, copies long, home int, probes array<int>, codes binary, error float"), "indexed")
    queries = indexed.select("cid", "vector", "copies", "home", F.explode("probes").alias("list"))
    # At most MOST_LISTS rows each: how many blocks a list has as candidates and as queries.
    in_list = indexed.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("held"))
    by_list = queries.groupBy("list").agg(F.count("*").alias("asked")).join(in_list, "list")
    sizes = {r["list"]: (blocks(r["asked"], block), blocks(r["held"], block)) for r in by_list.collect()}
    per_list = F.create_map(*(F.lit(v) for k, (q, c) in sizes.items() for v in (k, q * 100_000 + c)))
    of = lambda c: F.element_at(per_list, F.col(c))
    spread = lambda count: F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))
    salt = lambda count: F.pmod(F.xxhash64("cid"), count).cast("int")
    asked = queries.where(of("list").isNotNull()).withColumn("q", F.floor(of("list") / 100_000)).withColumn("c", of("list") % 100_000)
    asked = asked.select("cid", "vector", "copies", "home", "list", salt(F.col("q")).alias("qb"), spread(F.col("c")).alias("cb"))
    held = indexed.withColumnRenamed("home", "list").where(of("list").isNotNull()).withColumn("q", F.floor(of("list") / 100_000)).withColumn("c", of("list") % 100_000)
    held = held.select("cid", "vector", "copies", "codes", "error", "probes", "list", salt(F.col("c")).alias("cb"), spread(F.col("q")).alias("qb"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": object, "b": object, "n": "Int64"})
        return compare_block(index, int(right["list"].iloc[0]), left, right, cosine)

    keys = ("list", "qb", "cb")
    found = stored(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(compare, "a string, b string, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null")).withColumnRenamed("node", "cid")
    done = classes.select("cid", "low", "copies").join(counts, "cid", "left").join(roots, "cid", "left")
    done = done.select("cid", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    lowest = done.groupBy("root").agg(F.min("low").alias("component_id"))
    done = done.join(lowest, "root").select("cid", "n_links", "component_id")
    out = rows.select("id", "cid").join(done, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
