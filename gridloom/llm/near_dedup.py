"""MinHash near-duplicates of whole documents: SuperMinHash, banding, exact verification, union-find.

Documents with the same set of word shingles form one class; only classes are compared. Classes that share a
band of their signatures are candidates, and a link counts only if the full sets have a Jaccard similarity of
at least ``percent`` hundredths. In small buckets the pairs are listed and verified by joins. Buckets with many
different classes overlap (they come from one text that was copied with many changes), so they are
put together into groups, and each group is compared once, in blocks: a task gets the full sets of two blocks, works out all
intersections as matrix products and returns a spanning forest of the links, never the pairs.

Null or empty texts and texts without words have an empty set and are linked with nothing. Repeated rows and equal ids
are rows of their own. A null id is no component's smallest id; a component of nothing but null ids has a null one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, slices, stored, text_batches
from gridloom.llm.components import components, spanning_forest
from gridloom.llm.shingles import shingle_sets
from gridloom.llm.superminhash import band_keys, signatures

BANDS, ROWS = 25, 5
#: Buckets with more classes are compared in blocks of at most so many classes and shingles.
LIGHT_BUCKET, BLOCK_CLASSES, BLOCK_SHINGLES = 32, 512, 2_000_000
#: Shingles whose columns are multiplied at once.
COLUMNS = 4096
#: Row keys that may be broadcast (some 40 bytes each); with more, documents and keys are shuffled.
BROADCAST_ROWS = 200_000


def row_key(key: str, text: str) -> Column:
    """An id for each pair of document id and text, never null."""
    return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(F.col(text)).cast("string"))


def signed_rows(docs: DataFrame, *, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """Columns key, row_key, set_id (binary, null for an empty set), n_shingles and buckets (a 64-bit key for each band)."""
    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, 1000):
            sets = list(shingle_sets(pdf["text"].tolist(), words))
            keys = band_keys(signatures(sets, bands * rows), bands, rows)
            yield pd.DataFrame(
                {
                    "key": pdf["key"],
                    "row_key": pdf["row_key"],
                    "set_id": [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets],
                    "n_shingles": [len(s) for s in sets],
                    "buckets": [k if len(s) else None for k, s in zip(keys, sets, strict=True)],
                }
            )

    rows_in = docs.select(F.col(key).alias("key"), row_key(key, text).alias("row_key"), F.col(text).alias("text"))
    return rows_in.mapInPandas(sign, f"key {kind}, row_key string, set_id binary, n_shingles long, buckets array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, *, key: str, text: str, words: int) -> DataFrame:
    """Columns set_id and shingles (array of 64-bit hashes) of the rows whose row_key is in ``wanted``."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(row_key(key, text).alias("row_key"), F.col(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "row_key", "left_semi")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, 1000):
            sets = list(shingle_sets(pdf["text"].tolist(), words))
            yield pd.DataFrame({"set_id": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "shingles": [s.view("int64") for s in sets]})

    return rows.select("text").mapInPandas(sets_of, "set_id binary, shingles array<long>").dropDuplicates(["set_id"])


def _close(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union."""
    one = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("of_a")), "a")
    two = one.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("of_b")), "b")
    shared = two.select("a", "b", F.size("of_a").alias("n"), F.size("of_b").alias("m"), F.size(F.array_intersect("of_a", "of_b")).alias("both"))
    return shared.where(F.col("both").cast("long") * 100 >= (F.col("n").cast("long") + F.col("m") - F.col("both")) * percent).select("a", "b")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, as sums of matrix products over slices of the common shingles."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32 if len(common) < 1 << 24 else np.float64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, values)
        found = at < len(common)
        found[found] = common[at[found]] == values[found]
        order = np.argsort(at[found], kind="stable")
        return at[found][order], owner[found][order]

    (a_at, a_owner), (b_at, b_owner) = places(left), places(right)
    for begin in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - begin)
        sides = []
        for at, owner, n in ((a_at, a_owner, len(left)), (b_at, b_owner, len(right))):
            i, j = np.searchsorted(at, [begin, begin + width])
            side = np.zeros((n, width), dtype=out.dtype)
            side[owner[i:j], at[i:j] - begin] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def block_forest(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Columns a and b: a spanning forest of the links between the classes of one block or two."""
    ids, sets = pdf["set_id"].tolist(), pdf["shingles"].tolist()
    first = pdf["block"].to_numpy() == pdf["i"].to_numpy()
    left = np.flatnonzero(first)
    right = np.flatnonzero(~first) if (~first).any() else left
    if not len(left):
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    both = shared_counts([sets[k] for k in left], [sets[k] for k in right])
    size = np.array([len(x) for x in sets])
    rows, cols = np.nonzero(both * 100 >= (size[left][:, None] + size[right][None, :] - both) * percent)
    root = spanning_forest(left[rows], right[cols], len(ids))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": [ids[k] for k in moved], "b": [ids[root[k]] for k in moved]}, dtype=object)


def heavy_groups(heavy: DataFrame) -> DataFrame:
    """Columns set_id and group of the classes of large buckets; buckets that overlap are in one group."""
    lowest = heavy.groupBy("bucket").agg(F.min("set_id").alias("low"))
    roots = components(heavy.join(lowest, "bucket").select(F.col("set_id").alias("a"), F.col("low").alias("b")))
    return stored(roots.select(F.col("node").alias("set_id"), F.col("root").alias("group")), "groups")


def heavy_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Columns a and b: links that connect all classes of a group which its links connect."""
    rows = groups.join(sets, "set_id").withColumn("n", F.size("shingles"))
    per_block = F.greatest(F.lit(8), F.least(F.lit(BLOCK_CLASSES), (BLOCK_SHINGLES / F.max("n")).cast("int")))
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))
    rows = rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.select("group", "set_id", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("group", "set_id", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return rows.groupBy("group", "i", "j").applyInPandas(lambda pdf: block_forest(pdf, percent), "a binary, b binary")


def linked_classes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Columns node and root of all classes that have a link; None without links.

    ``members`` has bucket, size (of the bucket), set_id and n, and is a stored table.
    """
    heavy = members.where(F.col("size") > LIGHT_BUCKET)
    groups = None if heavy.isEmpty() else heavy_groups(heavy)
    light = members.where(F.col("size") <= LIGHT_BUCKET)
    if groups is not None:
        light = light.join(groups, "set_id", "left")
    else:
        light = light.withColumn("group", F.lit(None).cast("binary"))
    other = light.select("bucket", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("group").alias("group2"))
    apart = F.coalesce(F.col("group") != F.col("group2"), F.lit(True))
    pairs = light.join(other, "bucket").where((F.col("set_id") < F.col("b")) & _close("n", "m", percent) & apart).select(F.col("set_id").alias("a"), "b").distinct()
    links = verified(pairs, sets, percent)
    if groups is not None:
        links = links.unionByName(heavy_links(groups, sets, percent))
    links = stored(links, "links")
    return None if links.isEmpty() else components(links)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``key``, row_key, n_shingles, component_id (smallest id reachable), kept (``key`` is that id) and first.

    ``first`` is true for one (id, text) of each component, the one with the smallest id and row key; null ids come last.

    ``docs`` is read twice: for the signatures, and for the full sets of classes that have candidates.
    """
    signed = stored(signed_rows(docs, key=key, text=text, words=words, bands=bands, rows=rows), "signed")
    place = F.struct(F.col("key").isNull().alias("without"), "key", "row_key")  # null ids come last
    classes = signed.where("set_id is not null").groupBy("set_id").agg(F.min(place).alias("low"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = stored(classes, "classes")
    exploded = classes.select("set_id", "n", F.explode("buckets").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(exploded.join(shared, "bucket"), "members")
    wanted = classes.join(members.select("set_id").distinct(), "set_id", "left_semi").select("row_key")
    low = classes.select("set_id", "low")
    if not members.isEmpty():
        sets = stored(full_sets(docs, wanted, key=key, text=text, words=words), "sets")
        if (roots := linked_classes(members, sets, percent)) is not None:
            low = low.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
            lowest = low.groupBy("root").agg(F.min("low").alias("component_low"))
            low = low.join(lowest, "root").select("set_id", F.col("component_low").alias("low"))
    out = signed.select("key", "row_key", "set_id", "n_shingles").join(low, "set_id", "left")
    alone = F.col("set_id").isNull()
    component = F.when(alone, F.col("key")).otherwise(F.col("low.key"))
    return out.select(
        F.col("key").alias(key), "row_key", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"), (alone | (F.col("row_key") == F.col("low.row_key"))).alias("first")
    )


def without_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, once if its row is repeated.

    Of documents that share the smallest id or have no id one stays as well. Columns may have any names.
    """
    found = near_duplicates(docs, key=key, text=text, **options).where("first")
    at = fresh("row_key", docs.columns)
    keyed = docs.withColumn(at, row_key(key, text))
    return keyed.join(found.select(F.col("row_key").alias(at)).distinct(), at, "left_semi").dropDuplicates([at]).drop(at)
