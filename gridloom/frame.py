"""Frame: a table of time and cells with its items, dimensions and geometry. All methods give new frames and stay lazy.

A row is one time step of one cell; dimensions are columns (``time``, ``x_idx``, ``element``, ...), items are columns of
doubles with NaN where there is no value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.functions import time as times
from gridloom.functions.joins import spread
from gridloom.geometry import Geometry0D, Grid1D, Grid2D, Point2D, Undefined
from gridloom.items import Item, ItemsError, unique_names
from gridloom.geometry.base import OutsideDomainError
from gridloom.geometry.layered import LayeredMesh
from gridloom.geometry.mesh import centroids
from gridloom.geometry.spectrum import PointSpectrum
from gridloom.operators import aggregate, combine, interpolate, mesh, select

Number = int | float


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    items: tuple[Item, ...]
    dims: tuple[str, ...] = ("time",)
    geometry: object = field(default_factory=Geometry0D)
    title: str = ""

    @classmethod
    def of(cls, df: DataFrame, dims: Sequence[str] = ("time",), items: Sequence[Item | str] | None = None, geometry: object = None, title: str = "") -> Frame:
        """A frame over a table; by default all columns that are no dimension are items."""
        found = [Item(i) if isinstance(i, str) else i for i in (items if items is not None else [c for c in df.columns if c not in dims])]
        names = unique_names(i.name for i in found)
        if names != [i.name for i in found]:
            raise ValueError("two items have the same name")
        space = tuple(d for d in dims if d != "time")
        typed = df.select(*dims, *(nan.num(i.name).alias(i.name, metadata=i.metadata()) for i in found))
        return cls(typed, tuple(found), tuple(dims), geometry or (Undefined(space) if space else Geometry0D()), title)

    # what is in it

    @property
    def names(self) -> list[str]:
        return [i.name for i in self.items]

    @property
    def space_dims(self) -> tuple[str, ...]:
        return tuple(d for d in self.dims if d != "time")

    @property
    def n_items(self) -> int:
        return len(self.items)

    def time_axis(self) -> DataFrame:
        return times.steps(self.df)

    def is_equidistant(self) -> bool:
        return bool(times.is_equidistant(self.df).first()["is_equidistant"])

    def timestep(self) -> float | None:
        """Seconds between the first two steps."""
        return times.is_equidistant(self.df).first()["timestep"]

    def n_steps(self) -> int:
        return self.df.select("time").distinct().count()

    def _with(self, df: DataFrame, **changes: object) -> Frame:
        return replace(self, df=df, **changes)

    # items

    def __getitem__(self, wanted: str | int | slice | Column | tuple | Sequence[str | int]) -> Frame:
        """Items by name, number or wildcard; places by a slice, or a tuple of slices and numbers in the order of the dimensions; a mask as a column makes
        values NaN where it doesn't hold."""
        if isinstance(wanted, Column):
            return self.where(~wanted)
        if isinstance(wanted, slice) or (isinstance(wanted, tuple) and all(isinstance(w, (int, slice)) for w in wanted)):
            return self._at_places(wanted if isinstance(wanted, tuple) else (wanted,))
        names = select.match_items(self.names, wanted)
        return self._with(self.df.select(*self.dims, *names), items=tuple(next(i for i in self.items if i.name == n) for n in names))

    def _at_places(self, places: tuple[int | slice, ...]) -> Frame:
        if len(places) > len(self.dims):
            raise IndexError(f"{len(places)} places for {len(self.dims)} dimensions")
        at = {d: p for d, p in zip(self.dims, places, strict=False) if p != slice(None)}
        found = self.isel(**at) if at else self
        if isinstance(at.get("time"), int):
            found = found._with(found.df.drop("time"), dims=tuple(d for d in found.dims if d != "time"))
        return found

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def column(self, name: str) -> Column:
        if name not in self.names:
            raise ItemsError(name, self.names)
        return self.df[name]

    def rename(self, names: dict[str, str]) -> Frame:
        """Items keep their places."""
        for n in names:
            if n not in self.names:
                raise ItemsError(n, self.names)
        return self._with(self.df.withColumnsRenamed(names), items=tuple(i.renamed(names.get(i.name, i.name)) for i in self.items))

    def with_item(self, item: Item | str, value: Column) -> Frame:
        item = Item(item) if isinstance(item, str) else item
        kept = tuple(i for i in self.items if i.name != item.name)
        return self._with(self.df.withColumn(item.name, nan.num(value)), items=(*kept, item))

    def insert(self, at: int, item: Item | str, value: Column) -> Frame:
        """A new item in place ``at`` of the others."""
        item = Item(item) if isinstance(item, str) else item
        if item.name in self.names:
            raise ValueError(f"there is an item {item.name!r} already")
        items = list(self.items)
        items.insert(at, item)
        df = self.df.withColumn(item.name, nan.num(value).alias(item.name, metadata=item.metadata()))
        return self._with(df.select(*self.dims, *(i.name for i in items)), items=tuple(items))

    def drop(self, wanted: str | Sequence[str]) -> Frame:
        gone = select.match_items(self.names, wanted)
        return self[[n for n in self.names if n not in gone]]

    # axes

    def flipud(self) -> Frame:
        """Values upside down along the first axis in space; the geometry stays."""
        if not self.space_dims:
            raise ValueError("there is no axis in space")
        d = self.space_dims[0]
        return self._with(self.df.withColumn(d, F.lit(self._n_cells(d) - 1).cast(self.df.schema[d].dataType) - F.col(d)))

    def squeeze(self) -> Frame:
        """Without the axes that have one step or cell only."""
        gone = [d for d in self.dims if (self.n_steps() if d == "time" else self._n_cells(d)) == 1]
        space = [d for d in gone if d != "time"]
        geometry = self.geometry.reduce([*space, *(d.removesuffix("_idx") for d in space)]) if space and hasattr(self.geometry, "reduce") else self.geometry
        return self._with(self.df.drop(*gone), dims=tuple(d for d in self.dims if d not in gone), geometry=geometry)

    # selection

    def _n_cells(self, dim: str) -> int:
        axes = getattr(self.geometry, "axes", {})
        if (axis := axes.get(dim.removesuffix("_idx"))) is not None:
            return axis.n
        return (self.df.agg(F.max(dim)).first()[0] or 0) + 1

    def isel(self, time: int | slice | Sequence[int] | None = None, **cells: int | Sequence[int] | slice) -> Frame:
        """By number; negative numbers count from the end. An integer drops a spatial axis; dimensions are named as columns.

        Cells of a slice or a list are numbered anew, and the grid is cut with them (it is undefined for cells that aren't
        equally spaced). Elements of a mesh keep their ids.
        """
        df, dims, geometry = self.df, self.dims, self.geometry
        if time is not None:
            df = select.steps_at(df, time)
        for d, at in cells.items():
            if d not in dims:
                raise ValueError(f"no dimension {d!r}")
            wanted, name = select.places(at, self._n_cells(d), d), d.removesuffix("_idx")
            if isinstance(at, int):
                df, dims = df.where(F.col(d) == wanted[0]).drop(d), tuple(x for x in dims if x != d)
                geometry = geometry.reduce([d, name]) if hasattr(geometry, "reduce") else geometry
            elif hasattr(geometry, "as_tables"):
                df = select.cells_at(df, d, wanted, anew=False)
                mesh = geometry.as_tables(df.sparkSession)
                geometry = mesh.keep(select.cells_at(mesh.elements.select("element"), "element", wanted, anew=False))
            else:
                df = select.cells_at(df, d, wanted)
                geometry = self._cut(geometry, name, wanted)
        return self._with(df, dims=dims, geometry=geometry)

    def _cut(self, geometry: object, name: str, wanted: Sequence[int]) -> object:
        if name not in getattr(geometry, "axes", {}):
            return geometry
        gaps = {b - a for a, b in zip(wanted, wanted[1:], strict=False)}
        if not len(wanted) or len(gaps) > 1 or any(g <= 0 for g in gaps):
            return Undefined(self.space_dims)
        return geometry.cut(**{name: wanted})

    def sel(self, time: str | datetime | slice | None = None, area: Sequence | None = None, layers: str | int | Sequence[str | int] | None = None, **at: Number | slice) -> Frame:
        """By label: times (partial ones stand for their period, both ends of slices count), a box, or coordinates.

        On a grid the cells that are left are numbered anew and the grid is cut with them. On a mesh ``area`` may also be a polygon of (x, y)
        corners and ``x`` and ``y`` choose the element that holds the point; elements keep their ids. On a layered mesh ``x`` and ``y`` choose a column, with
        ``z`` the element between whose faces it lies; ``layers`` ("bottom", "top", numbers) may be combined with either. On spectra ``area`` and ``x`` with
        ``y`` choose elements, ``element`` or ``node`` choose by id.
        """
        if area is not None and at:
            raise ValueError("give an area or coordinates, not both")
        df, dims, geometry = self.df, self.dims, self.geometry
        if isinstance(time, slice):
            df = select.time_slice(df, time.start, time.stop)
        elif time is not None:
            df = select.at_time(df, time)
        if isinstance(geometry, LayeredMesh):
            return self._with(df)._sel_on_layers(area, layers, at)
        if layers is not None:
            raise ValueError("the geometry has no layers")
        if (area is not None or at) and isinstance(geometry, PointSpectrum):
            return self._with(df)._sel_on_spectrum(area, at)
        if (area is not None or at) and hasattr(geometry, "as_tables"):
            return self._with(df)._sel_on_mesh(area, at)
        axes = getattr(geometry, "axes", {})
        if area is not None:
            left, bottom, right, top = area
            at = {"x": slice(left, right), "y": slice(bottom, top)}
        dropped = []
        for d, value in at.items():
            if d not in axes:
                raise ValueError(f"no coordinate {d!r}")
            axis, name = axes[d], f"{d}_idx"
            if isinstance(value, slice):
                if area is not None:
                    inside = [i for i, c in enumerate(axis.centres) if value.start <= c <= value.stop]
                    cells = range(inside[0], inside[-1] + 1) if inside else range(0)
                else:
                    cells = axis.between(value.start, value.stop)
                df, geometry = select.cells_at(df, name, cells), self._cut(geometry, d, cells)
            else:
                cell = self.geometry.find_index(**{d: value})[d]
                df, dims = df.where(F.col(name) == cell).drop(name), tuple(x for x in dims if x != name)
                dropped.append(d)
        return self._with(df, dims=dims, geometry=geometry.reduce(dropped) if dropped else geometry)

    def _sel_on_mesh(self, area: Sequence | None, at: dict[str, Number]) -> Frame:
        spark = self.df.sparkSession
        table = self.geometry.as_tables(spark)
        if area is not None:
            ids = mesh.elements_in(table.nodes, table.elements, area)
            return self._with(self.df.join(spread(ids), "element", "left_semi"), geometry=table.keep(ids))
        if set(at) != {"x", "y"}:
            raise ValueError("a point in a mesh has x and y")
        point = spark.range(1).select(F.col("id").alias("point"), *(F.lit(float(v)).alias(c) for c, v in at.items()))
        element = mesh.find_elements(point, table.nodes, table.elements).first()["element"]
        if element is None:
            raise OutsideDomainError(at["x"], at["y"])
        return self._with(self.df.where(F.col("element") == element).drop("element"), dims=tuple(d for d in self.dims if d != "element"), geometry=Geometry0D())

    def _sel_on_layers(self, area: Sequence | None, layers: str | int | Sequence[str | int] | None, at: dict[str, Number]) -> Frame:
        if area is None and layers is None and not at:
            return self
        if at and set(at) not in ({"x", "y"}, {"x", "y", "z"}):
            raise ValueError("a point in a layered mesh has x and y, or x, y and z")
        found = None if layers is None else self.geometry.layer_elements(layers)
        if area is not None or at:
            there = self.geometry.area_elements(area) if area is not None else self.geometry.point_elements(self.df.sparkSession, **at)
            found = there if found is None else there.join(spread(found), "element", "left_semi")
        return self._at_elements(found, self.geometry.keep(found))

    def _at_elements(self, ids: DataFrame, geometry: object) -> Frame:
        """Rows of some elements; a geometry that is one point drops the axis."""
        df, name = self.df.join(spread(ids), ids.columns[0], "left_semi"), ids.columns[0]
        if name in geometry.dims:
            return self._with(df, geometry=geometry)
        return self._with(df.drop(name), dims=tuple(d for d in self.dims if d != name), geometry=geometry)

    def _sel_on_spectrum(self, area: Sequence | None, at: dict) -> Frame:
        ids, geometry = self.geometry.select(self.df.sparkSession, area=area, **at)
        return self._at_elements(ids, geometry)

    def where(self, mask: Column, value: float = nan.NAN) -> Frame:
        """Values become ``value`` where the mask holds."""
        return self._with(select.where(self.df, self.names, mask, value))

    def fillna(self, value: float = 0.0) -> Frame:
        return self._with(select.fillna(self.df, self.names, value))

    def dropna(self) -> Frame:
        """Time steps at which all items have a value."""
        return self._with(select.dropna(self.df, self.names))

    # reductions

    def _reduced(self, axis: str | Sequence[str] | None) -> tuple[list[str], list[str]]:
        """Dimensions that stay and that go."""
        if axis is None:
            gone = list(self.dims)
        elif axis == "space":
            gone = list(self.space_dims)
        else:
            gone = [axis] if isinstance(axis, str) else list(axis)
        for d in gone:
            if d not in self.dims:
                raise ValueError(f"no dimension {d!r}")
        return [d for d in self.dims if d not in gone], gone

    def aggregate(self, how: str | Callable[[Column], Column], axis: str | Sequence[str] | None = "time", *, keep_first_time: bool = False) -> Frame:
        """A reduction along "time", "space", dimensions, everything (None), or over "items".

        Over items a function takes the list of their columns. With ``keep_first_time`` a reduction over time keeps its first stamp.
        """
        if axis == "items" and not isinstance(how, str):
            name = getattr(how, "__name__", "value").strip("<>")
            return self._with(self.df.select(*self.dims, nan.num(how([nan.num(i) for i in self.names])).alias(name)), items=(Item(name),))
        if axis == "items":
            same = {(i.quantity, i.unit) for i in self.items}
            item = Item(how, *next(iter(same))) if len(same) == 1 else Item(how)
            return self._with(aggregate.across_items(self.df, self.dims, self.names, how), items=(item,))
        keys, gone = self._reduced(axis)
        stamp = keep_first_time and "time" in gone
        df = aggregate.reduce(self.df, keys, self.names, how, time="time" if stamp else None)
        return self._with(df, dims=("time", *keys) if stamp else tuple(keys), geometry=self._geometry_without(gone))

    def apply(self, function: Callable[[pd.Series], float], axis: str | Sequence[str] = "time") -> Frame:
        """A reduction by any function of a group's values; a group has to fit into a task's memory."""
        keys, gone = self._reduced(axis)
        return self._with(aggregate.reduce_with(self.df, keys, self.names, function), dims=tuple(keys), geometry=self._geometry_without(gone))

    def _geometry_without(self, gone: Sequence[str]) -> object:
        names = [g.removesuffix("_idx") for g in gone if g != "time"] + [g for g in gone if g != "time"]
        return self.geometry.reduce(names) if names and hasattr(self.geometry, "reduce") else self.geometry

    def max(self, axis: str | None = "time") -> Frame:
        return self.aggregate("max", axis)

    def min(self, axis: str | None = "time") -> Frame:
        return self.aggregate("min", axis)

    def mean(self, axis: str | None = "time") -> Frame:
        return self.aggregate("mean", axis)

    def std(self, axis: str | None = "time") -> Frame:
        return self.aggregate("std", axis)

    def ptp(self, axis: str | None = "time") -> Frame:
        return self.aggregate("ptp", axis)

    def nanmax(self, axis: str | None = "time") -> Frame:
        return self.aggregate("nanmax", axis)

    def nanmin(self, axis: str | None = "time") -> Frame:
        return self.aggregate("nanmin", axis)

    def nanmean(self, axis: str | None = "time") -> Frame:
        return self.aggregate("nanmean", axis)

    def nanstd(self, axis: str | None = "time") -> Frame:
        return self.aggregate("nanstd", axis)

    def average(self, weights: Column, axis: str | None = "time") -> Frame:
        keys, gone = self._reduced(axis)
        return self._with(aggregate.average(self.df, keys, self.names, weights), dims=tuple(keys), geometry=self._geometry_without(gone))

    def quantile(self, q: float | Sequence[float], axis: str | None = "time", *, skip_nan: bool = False) -> Frame:
        """Exact quantiles; a list makes one item for each."""
        if axis == "items":
            return self._with(aggregate.quantile_across_items(self.df, self.dims, self.names, q, skip_nan=skip_nan), items=(Item(f"Quantile {q}"),))
        keys, gone = self._reduced(axis)
        df = aggregate.quantile(self.df, keys, self.names, q, skip_nan=skip_nan)
        items = self.items if isinstance(q, (int, float)) else tuple(i.renamed(f"Quantile {one}, {i.name}") for one in q for i in self.items)
        return self._with(df, dims=tuple(keys), items=items, geometry=self._geometry_without(gone))

    def nanquantile(self, q: float | Sequence[float], axis: str | None = "time") -> Frame:
        return self.quantile(q, axis, skip_nan=True)

    def describe(self, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        return aggregate.describe(self.df, self.names, percentiles)

    # arithmetic

    def _operate(self, other: Frame | Number, operator: str, *, swapped: bool = False) -> Frame:
        if isinstance(other, Frame):
            if len(other.items) not in (1, len(self.items)):
                raise ValueError("both frames need as many items")
            return self._with(combine.binary(self.df, other.df, self.dims, self.names, operator, other.names))
        return self._with(combine.scalar(self.df, self.names, operator, other, swapped=swapped))

    def __add__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "+")

    __radd__ = __add__

    def __sub__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "-")

    def __rsub__(self, other: Number) -> Frame:
        return self._operate(other, "-", swapped=True)

    def __mul__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "*")

    __rmul__ = __mul__

    def __truediv__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "/")

    def __floordiv__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "//")

    def __mod__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "%")

    def __pow__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "**")

    def __neg__(self) -> Frame:
        return self._with(combine.unary(self.df, self.names, "-"))

    def __pos__(self) -> Frame:
        return self

    def __abs__(self) -> Frame:
        return self._with(combine.unary(self.df, self.names, "abs"))

    def __lt__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "<")

    def __le__(self, other: Frame | Number) -> Frame:
        return self._operate(other, "<=")

    def __gt__(self, other: Frame | Number) -> Frame:
        return self._operate(other, ">")

    def __ge__(self, other: Frame | Number) -> Frame:
        return self._operate(other, ">=")

    def equals(self, other: Frame | Number) -> Frame:
        """Element by element; NaN equals nothing."""
        return self._operate(other, "==")

    def differs(self, other: Frame | Number) -> Frame:
        return self._operate(other, "!=")

    # combination

    @staticmethod
    def merge(frames: Sequence[Frame]) -> Frame:
        first = frames[0]
        for f in frames[1:]:
            if f.dims != first.dims:
                raise ValueError("frames with different dimensions can't be merged")
            if not combine.same_keys(first.df, f.df, first.dims):
                raise ValueError("frames with different times or cells can't be merged")
        return first._with(combine.merge([f.df for f in frames], first.dims), items=tuple(i for f in frames for i in f.items))

    @staticmethod
    def concat(frames: Sequence[Frame], keep: str = "last") -> Frame:
        first = frames[0]
        for f in frames:
            if f.names != first.names or f.dims != first.dims:
                raise ValueError("frames with different items or dimensions can't be concatenated")
            if combine.has_duplicate_times(f.df, f.dims):
                raise ValueError("duplicate timestamps in one of the frames")
        return first._with(combine.concat([f.df for f in frames], first.dims, keep=keep))

    # interpolation

    def interp_time(self, target: DataFrame | Frame | str | Number, *, method: str = "linear", extrapolate: bool = True, fill_value: float = nan.NAN) -> Frame:
        """Onto the times of a table or frame, or a regular step ("6h", seconds). Outside the range: ``fill_value``, or ValueError without ``extrapolate``."""
        if isinstance(target, Frame):
            target = target.df
        ends = None
        if not isinstance(target, DataFrame):
            ends = self.df.agg(F.min("time"), F.max("time")).first()
            target = times.regular(self.df.sparkSession, ends[0], ends[1], target)
        if not extrapolate:
            ends = ends or self.df.agg(F.min("time"), F.max("time")).first()
            if not target.where((F.col("time") < times.literal(ends[0])) | (F.col("time") > times.literal(ends[1]))).isEmpty():
                raise ValueError("times outside the range of the data")
        df = interpolate.interp_time(self.df, target, list(self.space_dims), self.names, method=method, fill_value=fill_value)
        return self._with(df.select(*self.dims, *self.names))

    def interp_na(self, *, extrapolate: bool = False) -> Frame:
        return self._with(interpolate.interp_na(self.df, list(self.space_dims), self.names, extrapolate=extrapolate))

    def interp(self, points: DataFrame | None = None, *, x: Number | None = None, y: Number | None = None, n_nearest: int = 5, **weights: object) -> Frame:
        """Values at points (point and coordinates), or at one point: linear on a line, bilinear on a grid, by inverse distances on a mesh."""
        one = points is None
        if one:
            at = {"x": x, "y": y} if isinstance(self.geometry, Grid2D) or hasattr(self.geometry, "as_tables") else {self.geometry.dims[0] if self.geometry.dims else "x": x}
            if any(v is None for v in at.values()):
                raise ValueError("give " + " and ".join(at))
            points = self.df.sparkSession.range(1).select(F.col("id").alias("point"), *(F.lit(float(v)).alias(c) for c, v in at.items()))
        df, keys = self._at_points(points, n_nearest, weights)
        if one:
            return self._with(df.drop("point"), dims=tuple(keys), geometry=Point2D(float(x), float(y)) if y is not None else Geometry0D())
        return self._with(df, dims=(*keys, "point"), geometry=Undefined(("point",)))

    def _at_points(self, points: DataFrame, n_nearest: int, weights: dict) -> tuple[DataFrame, list[str]]:
        g, keys = self.geometry, [d for d in self.dims if d == "time"]
        if isinstance(g, Grid2D):
            return interpolate.interp_grid(self.df, points, g, self.names, keys=keys), keys
        if isinstance(g, Grid1D):
            return interpolate.interp_line(self.df, points, g, self.names, keys=keys), keys
        if hasattr(g, "as_tables") and not isinstance(g, LayeredMesh):
            table = g.as_tables(self.df.sparkSession)
            table_of = mesh.regrid_weights(points, table.nodes, table.elements, k=n_nearest, **weights)
            return interpolate.apply_weights(self.df, table_of, self.names, keys=keys), keys
        raise ValueError("values are interpolated on lines, grids of x and y, and flat meshes")

    def interp_like(self, other: Frame | DataFrame | object, *, n_nearest: int = 5, method: str = "linear", **weights: object) -> Frame:
        """Onto the cells of another frame or geometry (a line, grid or mesh) and, of a frame, its times too; onto a table of times, or by a table of
        weights (point, element, weight) that was worked out before.

        Weights are made of the two geometries by a join in bins, used for all items and steps, and the brackets in time are found on their result in the same plan.
        """
        spark = self.df.sparkSession
        if isinstance(other, DataFrame):
            if "weight" in other.columns:
                return self._with(interpolate.apply_weights(self.df, other, self.names), dims=("time", "point"), geometry=Undefined(("point",)))
            return self.interp_time(other, method=method)
        g = other.geometry if isinstance(other, Frame) else other
        if isinstance(g, (Grid1D, Grid2D)):
            points = g.cells(spark).withColumnRenamed("cell", "point")
        elif hasattr(g, "as_tables") and not isinstance(g, LayeredMesh):
            table = g.as_tables(spark)
            points = centroids(table.nodes, table.elements).select(F.col("element").alias("point"), "x", "y")
        else:
            raise ValueError("the other geometry is a line, a grid of x and y, or a flat mesh")
        df, keys = self._at_points(points, n_nearest, weights)
        if isinstance(g, Grid2D):
            dims, cells = ("y_idx", "x_idx"), {"y_idx": F.floor(F.col("point") / g.x.n).cast("int"), "x_idx": (F.col("point") % g.x.n).cast("int")}
        elif isinstance(g, Grid1D):
            dims = (f"{g.name}_idx",)
            cells = {dims[0]: F.col("point").cast("int")}
        else:
            dims, cells = ("element",), {"element": F.col("point")}
        done = self._with(df.withColumns(cells).select(*keys, *dims, *self.names), dims=(*keys, *dims), geometry=g)
        return done.interp_time(other, method=method) if isinstance(other, Frame) and "time" in keys and "time" in other.dims else done

    def extract_track(self, track: DataFrame, elements: DataFrame | None = None, *, method: str = "nearest", step_seconds: float | None = None, columns: Sequence[str] = ("time", "x", "y")) -> DataFrame:
        """Values along a moving point, whose time and coordinates are in ``columns`` of ``track``. Elements are those of the geometry unless given."""
        step = step_seconds or self.timestep()
        if elements is None:
            table = self.geometry.as_tables(self.df.sparkSession)
            elements = centroids(table.nodes, table.elements)
        named = dict(zip(columns, ("time", "x", "y"), strict=True))
        done = interpolate.extract_track(self.df, track.withColumnsRenamed(named), elements, self.names, method=method, step_seconds=step)
        return done.withColumnsRenamed({v: k for k, v in named.items()})

    # out

    def to_pandas(self) -> pd.DataFrame:
        """All rows on the driver; for results that are known to be small."""
        return self.df.orderBy(*self.dims).toPandas()

    def to_numpy(self) -> dict[str, np.ndarray]:
        """A dense array of each item by the dimensions in their order, NaN where there is no row; for results that are known to be small."""
        rows = self.to_pandas()
        if not self.dims:
            return {n: rows[n].to_numpy() for n in self.names}
        codes = [pd.factorize(rows[d], sort=True) for d in self.dims]
        out = {}
        for n in self.names:
            out[n] = np.full([len(u) for _, u in codes], np.nan)
            out[n][tuple(c for c, _ in codes)] = rows[n]
        return out

    @classmethod
    def from_numpy(cls, spark: SparkSession, arrays: dict[str, np.ndarray], dims: Sequence[str], times: Sequence[datetime] | None = None, geometry: object = None) -> Frame:
        """A frame of arrays of one shape, one for each item; ``times`` are the steps of the dimension time."""
        shapes = {np.shape(a) for a in arrays.values()}
        if len(shapes) != 1 or len(shape := shapes.pop()) != len(dims):
            raise ValueError("all arrays need one length for each dimension")
        cells = dict(zip(dims, (i.ravel() for i in np.indices(shape, dtype=np.int32)), strict=True))
        if "time" in cells:
            cells["time"] = pd.to_datetime(list(times or [])).to_numpy()[cells["time"]]
        rows = pd.DataFrame(cells | {n: np.asarray(a, dtype=float).ravel() for n, a in arrays.items()})
        types = ", ".join(f"`{d}` {'timestamp_ntz' if d == 'time' else 'int'}" for d in dims)
        return cls.of(spark.createDataFrame(rows, types + "".join(f", `{n}` double" for n in arrays)), dims, list(arrays), geometry)
