"""Regular grids of one, two and three axes. Cells are found by arithmetic, never by a join."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.geometry.base import BoundingBox, Geometry0D, OutsideDomainError


@dataclass(frozen=True)
class Axis:
    """n equidistant centres from x0. ``ends`` holds the outer edges where these were given, as they can't be had from the centres without rounding."""

    x0: float
    dx: float
    n: int
    ends: Sequence[float] | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.n < 1 or self.dx <= 0:
            raise ValueError("an axis needs a positive step and at least one cell")

    @classmethod
    def parse(cls, x: Sequence[float] | None = None, x0: float = 0.0, dx: float | None = None, n: int | None = None) -> Axis:
        """From centres, or from start, step and number."""
        if x is None:
            if n is None:
                raise ValueError("give the centres, or their number")
            return cls(float(x0), float(dx or 1.0), int(n))
        steps = np.diff(np.asarray(x, dtype=float))
        if len(steps) == 0:
            return cls(float(x[0]), float(dx or 1.0), 1)
        if (steps <= 0).any() or not np.allclose(steps, steps[0], rtol=1e-3):
            raise ValueError("the centres have to rise in equal steps")
        return cls(float(x[0]), float((x[-1] - x[0]) / len(steps)), len(x))

    @property
    def centres(self) -> np.ndarray:
        return self.x0 + self.dx * np.arange(self.n)

    @property
    def edges(self) -> np.ndarray:
        return self.x0 + self.dx * (np.arange(self.n + 1) - 0.5)

    @property
    def left(self) -> float:
        return self.ends[0] if self.ends else self.x0 - self.dx / 2

    @property
    def right(self) -> float:
        return self.ends[1] if self.ends else self.x0 + self.dx * (self.n - 0.5)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.range(self.n).select(F.col("id").cast("int").alias(f"{name}_idx"), (F.lit(self.x0) + F.col("id") * self.dx).alias(name))

    def contains(self, x: Column) -> Column:
        return (x >= self.left) & (x <= self.right)

    def cell(self, x: Column) -> Column:
        """The cell that holds x; the far edge belongs to the last cell; null outside."""
        at = F.least(F.floor((x - self.left) / self.dx), F.lit(self.n - 1))
        return F.when(self.contains(x), at.cast("int"))

    def nearest(self, x: float) -> int:
        return int(np.argmin(np.abs(self.centres - x)))

    def between(self, low: float | None, high: float | None) -> range:
        """Cells of a half-open label slice, by nearest centres."""
        first = 0 if low is None else self.nearest(low)
        stop = self.n if high is None else self.nearest(high)
        return range(first, stop)

    def cut(self, cells: Sequence[int]) -> Axis:
        cells = list(cells)
        step = cells[1] - cells[0] if len(cells) > 1 else 1
        return Axis(self.x0 + self.dx * cells[0], self.dx * step, len(cells))

    @classmethod
    def spanning(cls, low: float, high: float, dx: float | None = None, n: int | None = None) -> Axis:
        """Cells between two edges; with a step, they are centred between them."""
        if n is not None:
            return cls(low + (high - low) / n / 2, (high - low) / n, n, (low, high))
        if dx is None:
            raise ValueError("give a step or a number of cells")
        n = max(1, math.ceil((high - low) / dx - 1e-9))
        return cls(low + (high - low - n * dx) / 2 + dx / 2, dx, n)


class _Grid:
    """What grids have in common: ``axes`` by dimension, outermost first."""

    axes: dict[str, Axis]

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(self.axes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.n for a in self.axes.values())

    def axis_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {d: a.table(spark, d) for d, a in self.axes.items()}

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells with their indices and coordinates, the last axis fastest."""
        total = math.prod(self.shape)
        rest, columns = F.col("id"), []
        for d, a in reversed(list(self.axes.items())):
            at = (rest % a.n).cast("int")
            columns = [at.alias(f"{d}_idx"), (F.lit(a.x0) + at * a.dx).alias(d), *columns]
            rest = F.floor(rest / a.n)
        return spark.range(total).select(F.col("id").alias("cell"), *columns)

    def contains(self, **at: Column) -> Column:
        keep = F.lit(True)
        for d, x in at.items():
            keep = keep & self.axes[d].contains(x)
        return keep

    def find_index(self, **at: float) -> dict[str, int]:
        """The cell of a point; OutsideDomainError if there is none."""
        for d, x in at.items():
            a = self.axes[d]
            if not a.left <= x <= a.right:
                raise OutsideDomainError(at.get("x"), at.get("y"), at.get("z"))
        return {d: min(self.axes[d].n - 1, int((x - self.axes[d].left) / self.axes[d].dx)) for d, x in at.items()}

    def find_cells(self, **at: Column) -> dict[str, Column]:
        """The cell of each row's point; null outside."""
        return {f"{d}_idx": F.when(self.contains(**at), self.axes[d].cell(x)).alias(f"{d}_idx") for d, x in at.items()}

    def reduce(self, dims: Sequence[str]) -> Geometry0D | Grid1D | Grid2D | Grid3D:
        left = {d: a for d, a in self.axes.items() if d not in dims}
        return _grid_of(left)

    def cut(self, **cells: Sequence[int] | int) -> Geometry0D | Grid1D | Grid2D | Grid3D:
        """The grid of some cells: an integer drops its axis."""
        left = {}
        for d, a in self.axes.items():
            if d not in cells:
                left[d] = a
            elif not isinstance(cells[d], int):
                left[d] = a.cut(cells[d])
        return _grid_of(left)


@dataclass(frozen=True)
class Grid1D(_Grid):
    x: Axis
    name: str = "x"

    @property
    def axes(self) -> dict[str, Axis]:
        return {self.name: self.x}

    def linear(self, x: Column) -> Column:
        """array<struct<<name>_idx, weight>> of the two centres around a place; NaN weights outside the outermost centres."""
        if self.x.n < 2:
            raise ValueError("a line of one cell can't be interpolated")
        f = (x - self.x.x0) / self.x.dx
        at = F.greatest(F.lit(0), F.least(F.floor(f), F.lit(self.x.n - 2))).cast("int")
        share = F.when((f >= 0) & (f <= self.x.n - 1), f - at).otherwise(F.lit(float("nan")))
        end = lambda i, w: F.struct((at + i).alias(f"{self.name}_idx"), w.alias("weight"))
        return F.array(end(0, 1 - share), end(1, share))


@dataclass(frozen=True)
class Grid2D(_Grid):
    """``origin`` and ``orientation`` are kept for rotated grids; lookups use local coordinates."""

    x: Axis
    y: Axis
    is_spectral: bool = False
    is_vertical: bool = False
    origin: tuple[float, float] = (0.0, 0.0)
    orientation: float = 0.0

    @property
    def axes(self) -> dict[str, Axis]:
        if self.is_spectral:
            return {"frequency": self.y, "direction": self.x}
        return {"z": self.y, "x": self.x} if self.is_vertical else {"y": self.y, "x": self.x}

    @classmethod
    def in_box(cls, box: BoundingBox | Sequence[float], dx: float | None = None, dy: float | None = None, nx: int | None = None, ny: int | None = None) -> Grid2D:
        """A grid in a box: by steps, by numbers, or with ten cells on the short side."""
        b = BoundingBox.parse(box)
        width, height = b.right - b.left, b.top - b.bottom
        if dx is None and dy is None and nx is None and ny is None:
            short = min(width, height) / 10
            nx, ny = max(1, round(width / short)), max(1, round(height / short))
        if dx is not None and dy is None and ny is None:
            dy = dx
        if nx is not None and ny is None and dy is None:
            ny = max(1, round(height / (width / nx)))
        if ny is not None and nx is None and dx is None:
            nx = max(1, round(width / (height / ny)))
        return cls(Axis.spanning(b.left, b.right, dx, nx), Axis.spanning(b.bottom, b.top, dy, ny))

    @property
    def box(self) -> BoundingBox:
        return BoundingBox(self.x.left, self.y.left, self.x.right, self.y.right)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """node, x and y of the corners of all cells, row by row."""
        w = self.x.n + 1
        at = F.col("id")
        return spark.range(w * (self.y.n + 1)).select(at.alias("node"), (F.lit(self.x.left) + at % w * self.x.dx).alias("x"), (F.lit(self.y.left) + F.floor(at / w) * self.y.dx).alias("y"))

    @classmethod
    def of_nodes(cls, x: Sequence[float], y: Sequence[float]) -> Grid2D:
        """The grid whose cells lie between equidistant lines: centres are halfway between them."""
        mid = lambda v: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
        return cls(Axis.parse(mid(x), dx=float(x[1] - x[0])), Axis.parse(mid(y), dx=float(y[1] - y[0])))

    def at_origin(self) -> Grid2D:
        """The same cells with the start of the axes moved into the origin."""
        return replace(self, x=replace(self.x, x0=0.0, ends=None), y=replace(self.y, x0=0.0, ends=None), origin=(self.origin[0] + self.x.x0, self.origin[1] + self.y.x0))

    def to_mesh(self, *, west: int = 2, east: int = 4, north: int = 5, south: int = 3):
        """Quadrilaterals with one code for the nodes of each side; corners take south before north, then east and west."""
        from gridloom.geometry.mesh import Mesh

        xs, ys = np.meshgrid(self.x.edges, self.y.edges)
        code = np.zeros(xs.shape, dtype=int)
        code[:, 0], code[:, -1] = west, east
        code[0, 1:], code[-1, :-1] = south, north
        at = np.arange(xs.size).reshape(xs.shape)
        quads = np.stack([at[:-1, :-1], at[:-1, 1:], at[1:, 1:], at[1:, :-1]], axis=-1).reshape(-1, 4)
        return Mesh(np.column_stack([xs.ravel(), ys.ravel(), np.zeros(xs.size)]), [q.tolist() for q in quads], code.ravel())

    def bilinear(self, x: Column, y: Column) -> Column:
        """array<struct<x_idx, y_idx, weight>> of the four cells around a point; empty outside the outer centres' box."""
        fx, fy = (x - self.x.x0) / self.x.dx, (y - self.y.x0) / self.y.dx
        inside = (fx >= 0) & (fx <= self.x.n - 1) & (fy >= 0) & (fy <= self.y.n - 1)
        ix = F.greatest(F.lit(0), F.least(F.floor(fx), F.lit(max(0, self.x.n - 2)))).cast("int")
        iy = F.greatest(F.lit(0), F.least(F.floor(fy), F.lit(max(0, self.y.n - 2)))).cast("int")
        wx, wy = fx - ix, fy - iy
        corner = lambda i, j, w: F.struct((ix + i).alias("x_idx"), (iy + j).alias("y_idx"), w.alias("weight"))
        corners = F.array(corner(0, 0, (1 - wx) * (1 - wy)), corner(1, 0, wx * (1 - wy)), corner(0, 1, (1 - wx) * wy), corner(1, 1, wx * wy))
        return F.when(inside, F.filter(corners, lambda c: c["weight"] > 0))


@dataclass(frozen=True)
class Grid3D(_Grid):
    x: Axis
    y: Axis
    z: Axis

    @property
    def axes(self) -> dict[str, Axis]:
        return {"z": self.z, "y": self.y, "x": self.x}


def _grid_of(axes: dict[str, Axis]) -> Geometry0D | Grid1D | Grid2D | Grid3D:
    names = set(axes)
    if not names:
        return Geometry0D()
    if names == {"x", "y", "z"}:
        return Grid3D(axes["x"], axes["y"], axes["z"])
    if names == {"x", "y"}:
        return Grid2D(axes["x"], axes["y"])
    if names == {"x", "z"}:
        return Grid2D(axes["x"], axes["z"], is_vertical=True)
    if len(names) == 1:
        (name,) = names
        return Grid1D(axes[name], name)
    first, second = axes
    return Grid2D(axes[second], axes[first], is_spectral="frequency" in names)


def logarithmic_frequencies(n: int = 25, f0: float = 0.055, factor: float = 1.1) -> np.ndarray:
    return f0 * factor ** np.arange(n)
