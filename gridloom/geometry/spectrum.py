"""Axes of wave spectra: frequencies and directions at a point, along a line or over a mesh."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.geometry.base import Geometry0D, OutsideDomainError
from gridloom.geometry.mesh import Mesh, TableMesh, centroids


def bin_widths(frequencies: Sequence[float]) -> np.ndarray:
    """The widths of frequency bins: equal steps for a linear axis, else f times half the span of the geometric factor."""
    f = np.asarray(frequencies, dtype=float)
    if len(f) < 2:
        return np.ones(len(f))
    steps = np.diff(f)
    if np.allclose(steps, steps[0], rtol=1e-4):
        return np.full(len(f), steps[0])
    factor = f[1] / f[0]
    return f * (factor - 1 / factor) / 2


@dataclass(frozen=True)
class PointSpectrum:
    frequencies: tuple[float, ...]
    directions: tuple[float, ...] = ()
    space: tuple[str, ...] = ()
    x: float | None = None
    y: float | None = None

    def in_degrees(self, unit: str) -> PointSpectrum:
        """The same axes with directions that are given in ``unit`` ("degree" or "radian") as degrees."""
        if unit not in ("degree", "radian"):
            raise ValueError(f"directions are in degree or radian, not {unit!r}")
        return self if unit == "degree" else replace(self, directions=tuple(float(d) for d in np.rad2deg(self.directions)))

    def select(self, spark: SparkSession, **at: object) -> tuple[DataFrame, PointSpectrum]:
        """A table of ids and the geometry of what is chosen."""
        raise ValueError("a point spectrum has no elements or nodes to choose from")

    def _as_point(self, x: float, y: float) -> PointSpectrum:
        return PointSpectrum(self.frequencies, self.directions, x=float(x), y=float(y))

    @property
    def dims(self) -> tuple[str, ...]:
        return (*self.space, *(["direction"] if self.directions else []), "frequency")

    @property
    def direction_step(self) -> float:
        """Radians."""
        if len(self.directions) < 2:
            return 1.0
        return float(np.deg2rad(abs(self.directions[1] - self.directions[0])))

    def axis_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        widths = bin_widths(self.frequencies)
        tables = {"frequency": spark.createDataFrame([(i, float(f), float(w)) for i, (f, w) in enumerate(zip(self.frequencies, widths, strict=True))], "frequency_idx int, frequency double, width double")}
        if self.directions:
            tables["direction"] = spark.createDataFrame([(i, float(d)) for i, d in enumerate(self.directions)], "direction_idx int, direction double")
        return tables

    def space_dims(self) -> tuple[str, ...]:
        if not self.space:
            raise ValueError("a point spectrum has no space axis")
        return self.space

    def reduce(self, dims: Sequence[str]) -> Geometry0D:
        return Geometry0D()


@dataclass(frozen=True)
class LineSpectrum(PointSpectrum):
    """Nodes along a line with their ids; ``segments`` are pairs of ids (by default of neighbours)."""

    nodes: tuple[tuple[float, float], ...] = ()
    space: tuple[str, ...] = ("node",)
    ids: tuple[int, ...] = ()
    segments: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        if not self.ids:
            object.__setattr__(self, "ids", tuple(range(len(self.nodes))))
        if not self.segments:
            object.__setattr__(self, "segments", tuple(zip(self.ids, self.ids[1:], strict=False)))

    @classmethod
    def dummy(cls, n_nodes: int, frequencies: Sequence[float], directions: Sequence[float] = ()) -> LineSpectrum:
        """Nodes on a straight line from (0, 0) to (1, 1)."""
        at = np.linspace(0, 1, n_nodes)
        return cls(tuple(frequencies), tuple(directions), nodes=tuple((float(a), float(a)) for a in at))

    def keep(self, wanted: Sequence[int]) -> LineSpectrum | PointSpectrum:
        """The line of some nodes, which keep their ids; segments stay whose two nodes do. One node is a point."""
        chosen = set(wanted)
        if unknown := chosen - set(self.ids):
            raise ValueError(f"no node {min(unknown)}")
        kept = [(i, at) for i, at in zip(self.ids, self.nodes, strict=True) if i in chosen]
        if len(kept) == 1:
            return self._as_point(*kept[0][1])
        segments = tuple(s for s in self.segments if chosen.issuperset(s))
        if not segments:
            raise ValueError("no two of the nodes are neighbours")
        return replace(self, nodes=tuple(at for _, at in kept), ids=tuple(i for i, _ in kept), segments=segments)

    def select(self, spark: SparkSession, *, node: int | Sequence[int] | None = None, **at: object) -> tuple[DataFrame, PointSpectrum]:
        if node is None or any(v is not None for v in at.values()):
            raise ValueError("of a line spectrum nodes are chosen by id")
        wanted = [node] if isinstance(node, int) else [int(n) for n in node]
        return spark.createDataFrame([(n,) for n in wanted], "node int"), self.keep(wanted)


@dataclass(frozen=True)
class AreaSpectrum(PointSpectrum):
    mesh: Mesh | TableMesh | None = None
    space: tuple[str, ...] = ("element",)

    def keep(self, spark: SparkSession, ids: DataFrame) -> AreaSpectrum | PointSpectrum:
        """The area of some elements, which keep their ids. One element is a point, none is an error."""
        table = self.mesh.as_tables(spark).keep(ids)
        first = table.elements.limit(2)
        n = first.count()
        if not n:
            raise ValueError("no elements in the selection")
        if n == 1:
            c = centroids(table.nodes, first).first()
            return self._as_point(c["x"], c["y"])
        return replace(self, mesh=table)

    def select(self, spark: SparkSession, *, area: Sequence | None = None, element: int | Sequence[int] | None = None, x: float | None = None, y: float | None = None, **other: object) -> tuple[DataFrame, PointSpectrum]:
        """By a box or polygon, by element, or the element that holds (x, y)."""
        from gridloom.operators import mesh

        given = [area is not None, element is not None, x is not None or y is not None]
        if sum(given) != 1 or any(v is not None for v in other.values()) or (given[2] and (x is None or y is None)):
            raise ValueError("choose elements by area, by element, or by x and y")
        table = self.mesh.as_tables(spark)
        if area is not None:
            ids = mesh.elements_in(table.nodes, table.elements, area)
        elif element is not None:
            wanted = [element] if isinstance(element, int) else [int(e) for e in element]
            ids = spark.createDataFrame([(e,) for e in wanted], "element int")
        else:
            point = spark.range(1).select(F.col("id").alias("point"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
            found = mesh.find_elements(point, table.nodes, table.elements).first()["element"]
            if found is None:
                raise OutsideDomainError(x, y)
            ids = spark.createDataFrame([(found,)], "element int")
        return ids, self.keep(spark, ids)
