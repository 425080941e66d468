"""Meshes of triangles and quadrilaterals, flat or in layers.

A mesh is a description of two tables, nodes and elements; operators on it are plans over these tables. The
description is kept on the driver as arrays, which its users load from a mesh file once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.joins import spread
from gridloom.geometry.base import BoundingBox, Geometry0D

NODE_SCHEMA = "node int, x double, y double, z double, code int"
ELEMENT_SCHEMA = "element int, nodes array<int>"


@dataclass(frozen=True, eq=False)
class Mesh:
    nodes: np.ndarray  # (n, 3)
    elements: list[list[int]]
    codes: np.ndarray | None = None
    projection: str = "LONG/LAT"
    dims: tuple[str, ...] = field(default=("element",))

    def __post_init__(self) -> None:
        n = len(self.nodes)
        for i, e in enumerate(self.elements):
            if not e or min(e) < 0 or max(e) >= n:
                raise ValueError(f"element {i} has nodes outside 0 to {n - 1}")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Mesh) and self.projection == other.projection and np.array_equal(self.nodes, other.nodes)

    def __hash__(self) -> int:
        return hash((self.projection, self.nodes.tobytes()))

    @property
    def is_geo(self) -> bool:
        return self.projection == "LONG/LAT"

    @property
    def is_tri_only(self) -> bool:
        return self.max_nodes_per_element == 3

    @property
    def max_nodes_per_element(self) -> int:
        return max(map(len, self.elements))

    @property
    def boundary_codes(self) -> list[int]:
        return [] if self.codes is None else sorted({int(c) for c in self.codes if c > 0})

    def node_table(self, spark: SparkSession) -> DataFrame:
        codes = np.zeros(len(self.nodes), dtype=int) if self.codes is None else self.codes
        return spark.createDataFrame([(i, *map(float, xyz), int(c)) for i, (xyz, c) in enumerate(zip(self.nodes, codes, strict=True))], NODE_SCHEMA)

    def element_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, [int(n) for n in e]) for i, e in enumerate(self.elements)], ELEMENT_SCHEMA)

    def as_tables(self, spark: SparkSession) -> TableMesh:
        return TableMesh(self.node_table(spark), self.element_table(spark), self.projection, self.dims)

    @property
    def box(self) -> BoundingBox:
        (left, bottom), (right, top) = self.nodes[:, :2].min(axis=0), self.nodes[:, :2].max(axis=0)
        return BoundingBox(float(left), float(bottom), float(right), float(top))

    def overset_grid(self, dx: float | None = None, dy: float | None = None, nx: int | None = None, ny: int | None = None, buffer: float = 0.0):
        """A grid that covers the mesh."""
        from gridloom.geometry.grid import Grid2D

        b = self.box
        return Grid2D.in_box(BoundingBox(b.left - buffer, b.bottom - buffer, b.right + buffer, b.top + buffer), dx, dy, nx, ny)

    def subset(self, elements: Sequence[int]) -> Mesh:
        """Some elements, with nodes and elements numbered anew."""
        used = sorted({n for e in elements for n in self.elements[e]})
        number = {n: i for i, n in enumerate(used)}
        codes = None if self.codes is None else self.codes[used]
        return Mesh(self.nodes[used], [[number[n] for n in self.elements[e]] for e in elements], codes, self.projection)

    def reduce(self, dims: Sequence[str]) -> Mesh | Geometry0D:
        return Geometry0D() if "element" in dims or "space" in dims else self


@dataclass(frozen=True, eq=False)
class TableMesh:
    """A mesh of any size as its two tables: nodes (node, x, y, z, code) and elements (element, nodes). Elements keep their ids in selections."""

    nodes: DataFrame
    elements: DataFrame
    projection: str = "LONG/LAT"
    dims: tuple[str, ...] = field(default=("element",))

    def as_tables(self, spark: SparkSession) -> TableMesh:
        return self

    @property
    def is_geo(self) -> bool:
        return self.projection == "LONG/LAT"

    def box(self) -> BoundingBox:
        e = self.nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        return BoundingBox(*map(float, e))

    def overset_grid(self, dx: float | None = None, dy: float | None = None, nx: int | None = None, ny: int | None = None, buffer: float = 0.0):
        """A grid that covers the mesh."""
        from gridloom.geometry.grid import Grid2D

        b = self.box()
        return Grid2D.in_box(BoundingBox(b.left - buffer, b.bottom - buffer, b.right + buffer, b.top + buffer), dx, dy, nx, ny)

    def boundary_codes(self) -> list[int]:
        return sorted(r["code"] for r in self.nodes.where("code > 0").select("code").distinct().collect())  # a handful

    def check(self) -> None:
        """ValueError if an element has fewer than three nodes or one that there isn't."""
        used = self.elements.select("element", F.explode("nodes").alias("node"))
        bad = self.elements.where(F.size("nodes") < 3).select("element").union(used.join(spread(self.nodes), "node", "left_anti").select("element")).first()
        if bad is not None:
            raise ValueError(f"element {bad['element']} has too few nodes, or some that aren't there")

    def keep(self, ids: DataFrame) -> TableMesh:
        """The mesh of the elements in ``ids`` (a table with the column element), with the nodes that they use."""
        elements = self.elements.join(spread(ids), "element", "left_semi")
        used = elements.select(F.explode("nodes").alias("node"))
        return TableMesh(self.nodes.join(spread(used), "node", "left_semi"), elements, self.projection, self.dims)

    def reduce(self, dims: Sequence[str]) -> TableMesh | Geometry0D:
        return Geometry0D() if "element" in dims or "space" in dims else self


def corner_table(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """One row for each corner: element, corner (from 0), n_corners, node, x, y, z."""
    corners = elements.select("element", F.size("nodes").alias("n_corners"), F.posexplode("nodes").alias("corner", "node"))
    return corners.join(spread(nodes.select("node", "x", "y", "z")), "node")


def centroids(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """The mean of each element's corners: element, x, y, z."""
    return corner_table(nodes, elements).groupBy("element").agg(*(F.avg(c).alias(c) for c in ("x", "y", "z")))
