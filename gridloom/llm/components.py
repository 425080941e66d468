"""Connected components of a table of links by distributed union-find.

Each round every node hooks onto its smallest neighbour, pointers are halved, and the links are contracted to
the roots. A round at least halves the nodes that still have links. Tables of a round are written to the shared
folder, so that plans stay short and lost executors cost one round at most. Nothing reaches the driver but
counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stored, stored

JUMPS = 2


def _jump(parents: DataFrame) -> DataFrame:
    """Every node takes its parent's parent."""
    up = parents.where("node != parent").select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root: the smallest node that can be reached, for every node that has a link.

    Node ids may be of any type that has an order. Links of a node to itself, repeated links, links with a
    null end and links in either direction are allowed; an empty table gives an empty one.
    """
    later = F.col(a) > F.col(b)
    left = links.select(F.when(later, F.col(a)).otherwise(F.col(b)).alias("a"), F.when(later, F.col(b)).otherwise(F.col(a)).alias("b"))
    left = stored(left.where("a != b").distinct(), "links")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.when(F.col("low") < F.col("node"), F.col("low")).otherwise(F.col("node")).alias("parent"))
        for _ in range(JUMPS):
            parents = _jump(parents)
        parents = stored(parents, "parents")
        maps.append(parents)
        moved, contracted = parents.where("node != parent"), left
        for end in ("a", "b"):
            to = moved.select(F.col("node").alias(end), F.col("parent").alias("to"))
            contracted = contracted.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        contracted = stored(contracted.where("a != b").distinct(), "links")
        drop_stored(left)
        left = contracted
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    drop_stored(left)
    roots = maps[0].withColumnRenamed("parent", "root")
    for later in maps[1:]:
        step = later.where("node != parent").select(F.col("node").alias("root"), F.col("parent").alias("to"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots


def spanning_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links between nodes 0 to n - 1, the smallest node that each can reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (jumped := new[new] != new).any():
            new = np.where(jumped, new[new], new)
        new = new[root]
        if np.array_equal(new, root):
            return root
        root = new
