"""Frames as Parquet: partitioned by a part of the time and sorted by cell, so that filters on either prune files and row groups.

With ``tiles`` the cells of a grid or mesh are also clustered by a space-filling key: files lie in folders by tile, rows in the order of the key. The
geometry is written beside them, and a choice of area, elements or layers becomes tiles and ranges of keys before anything is scanned.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.functions import time as times
from gridloom.functions.joins import spread
from gridloom.functions.time import between, moment
from gridloom.geometry.grid import Axis, Grid2D, Grid3D
from gridloom.geometry.layered import LayeredMesh
from gridloom.geometry.mesh import TableMesh, centroids
from gridloom.geometry.tiles import Tiling
from gridloom.items import Item, ItemsError
from gridloom.operators.select import match_items
from gridloom.sources.shared import stored

#: How the partition column is made of the time.
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
#: Columns of the files that aren't the frame's.
_OWN = ("_batch", "_period", "_tile", "_key", "_layer")


# the geometry beside the rows


def _described(geometry: object, spark: SparkSession) -> str:
    """A text that is the same for equal geometries: meshes by digests of their tables, which Spark works out."""
    if hasattr(geometry, "as_tables"):
        table = geometry.as_tables(spark)
        digest = lambda df, *c: list(df.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({', '.join(c)}))")).first())
        return json.dumps([type(table).__name__, table.projection, digest(table.nodes, "node", "x", "y", "z"), digest(table.elements, "element", "nodes")])
    return repr(geometry)


def _places(geometry: object, spark: SparkSession) -> DataFrame | None:
    """element, x, y and _layer of a mesh's elements; None for geometries whose places are found by arithmetic, or that have none."""
    if isinstance(geometry, LayeredMesh):
        flat = geometry.flat()
        at = centroids(flat.nodes, flat.elements).select(F.col("element").alias("column"), "x", "y")
        return geometry.layers.join(spread(at), "column").select("element", "x", "y", F.col("layer").alias("_layer"))
    if hasattr(geometry, "as_tables"):
        table = geometry.as_tables(spark)
        return centroids(table.nodes, table.elements).select("element", "x", "y", F.lit(0).alias("_layer"))
    return None


def _tiled(frame: Frame, levels: int) -> tuple[DataFrame, Tiling, DataFrame | None]:
    """Rows with _key, _layer and _tile, the tiling, and the elements with their keys."""
    spark, g = frame.df.sparkSession, frame.geometry
    places = _places(g, spark)
    if places is not None:
        places = stored(places, "places")  # read for the box, the rows and the geometry beside them
        e = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        tiling = Tiling(*(float(v or 0) for v in e), levels)
        keyed = places.withColumn("_key", tiling.key(F.col("x"), F.col("y")))
        rows = frame.df.join(spread(keyed.select("element", "_key", "_layer")), "element")
        return rows.withColumn("_tile", tiling.tile(F.col("_key"))), tiling, keyed
    if isinstance(g, (Grid2D, Grid3D)) and {"x", "y"} <= set(g.axes):
        x, y = g.axes["x"], g.axes["y"]
        tiling = Tiling(float(x.left), float(y.left), float(x.right), float(y.right), levels)
        rows = frame.df.withColumn("_key", tiling.key(F.col("x_idx") * x.dx + x.x0, F.col("y_idx") * y.dx + y.x0)).withColumn("_layer", F.col("z_idx") if "z" in g.axes else F.lit(0))
        return rows.withColumn("_tile", tiling.tile(F.col("_key"))), tiling, None
    raise ValueError("only frames on grids with x and y and on meshes can be tiled")


def _write_geometry(frame: Frame, path: str, places: DataFrame | None) -> dict:
    g, spark = frame.geometry, frame.df.sparkSession
    if places is None:
        return {"axes": {d: asdict(a) for d, a in g.axes.items()}}
    table = g.as_tables(spark)
    places.sort("_key").write.mode("overwrite").parquet(f"{path}/_geometry/places")
    table.nodes.write.mode("overwrite").parquet(f"{path}/_geometry/nodes")
    table.elements.write.mode("overwrite").parquet(f"{path}/_geometry/elements")
    if not isinstance(g, LayeredMesh):
        return {"projection": table.projection}
    g.layers.write.mode("overwrite").parquet(f"{path}/_geometry/layers")
    return {"projection": table.projection, "n_layers": g.n_layers, "is_profile": g.is_profile}


def _read_geometry(spark: SparkSession, path: str, about: dict) -> object:
    g = about["geometry"]
    if "axes" in g:
        axes = {d: Axis(**a) for d, a in g["axes"].items()}
        return Grid3D(axes["x"], axes["y"], axes["z"]) if "z" in axes else Grid2D(axes["x"], axes["y"])
    table = lambda name: spark.read.parquet(f"{path}/_geometry/{name}")
    if "n_layers" in g:
        return LayeredMesh(table("nodes"), table("elements"), table("layers"), g["n_layers"], g["projection"], g["is_profile"])
    return TableMesh(table("nodes"), table("elements"), g["projection"])


def _about(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.parquet(f"{path}/_about").first()["about"])
    except AnalysisException:  # written without one
        return None


# rows


def write(frame: Frame, path: str, *, period: str = "month", mode: str = "errorifexists", tiles: int | None = None) -> None:
    """Write a frame; items and dimensions go into the metadata of the columns. With ``tiles`` (bits of each axis) cells are clustered in space."""
    spark = frame.df.sparkSession
    about: dict = {"dims": frame.dims, "described": _described(frame.geometry, spark), "tiles": tiles, "period": period}
    df, places = frame.df, None
    if tiles is not None:
        df, tiling, places = _tiled(frame, tiles)
        about["tiling"] = asdict(tiling)
    _write_rows(frame, df, path, period=period, mode=mode, batch="first")
    if tiles is not None:
        about["geometry"] = _write_geometry(frame, path, places)
    if "time" in frame.dims:
        about["step"] = _step(spark.read.parquet(path))
    spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}/_about")


def change_datatype(spark: SparkSession, path: str, datatype: int) -> None:
    """Give a dataset another tag, by which a model tells kinds of data apart. No row is written again."""
    about = (_about(spark, path) or {}) | {"datatype": int(datatype)}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_about")


def datatype(spark: SparkSession, path: str) -> int | None:
    return (_about(spark, path) or {}).get("datatype")


def _step(df: DataFrame) -> float | None:
    """Seconds between steps that are equally spaced, else None."""
    found = times.is_equidistant(df).first()
    return found["timestep"] if found["is_equidistant"] else None


def _write_rows(frame: Frame, df: DataFrame, path: str, *, period: str, mode: str, batch: str) -> None:
    for i in frame.items:
        df = df.withMetadata(i.name, i.metadata())
    folders, order = ["_batch"], []
    df = df.withColumn("_batch", F.lit(batch))
    if "time" in frame.dims:
        df, folders = df.withColumn("_period", F.date_format("time", PERIODS[period])), [*folders, "_period"]
    if "_tile" in df.columns:
        folders, order = [*folders, "_tile"], ["_layer", "_key"]
    # Rebalancing splits a period or tile that is much larger than others.
    ordered = df.hint("rebalance", *folders[1:]) if folders[1:] else df
    ordered = ordered.sortWithinPartitions(*folders[1:], *order, *frame.space_dims, *(["time"] if "time" in frame.dims else []))
    # Folders of the batch are replaced as a whole, so an attempt that is made again doesn't double its rows.
    ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def append(frame: Frame, path: str, *, period: str = "month", batch: str | None = None) -> None:
    """Add steps to a dataset that has the same items, dimensions and geometry; anything else is refused before a row is written.

    An item of undefined quantity is taken for the dataset's item of its name. Times that are there already are refused, as is
    another step if both have equal ones. A ``batch`` has a name: appended again under it (after a failure, say) it takes its own place.
    """
    spark = frame.df.sparkSession
    stored = spark.read.parquet(path)
    there = {f.name: f for f in stored.schema.fields if f.name not in _OWN}
    if set(there) != {*frame.dims, *frame.names}:
        raise ItemsError(next(iter(set(there) ^ {*frame.dims, *frame.names})), list(there))
    items = tuple(Item(i.name, **there[i.name].metadata) if i.quantity == "Undefined" else i for i in frame.items)
    for i in items:
        if there[i.name].metadata != i.metadata():
            raise ValueError(f"item {i.name!r} isn't the one of the dataset")
    frame = replace(frame, items=items)
    about = _about(spark, path) or {}
    period = about.get("period", period)
    if "described" in about and about["described"] != _described(frame.geometry, spark):
        raise ValueError("the geometry isn't the one of the dataset")
    if "time" in frame.dims:
        _check_times(frame, stored, about, period, batch)
    df = frame.df
    if about.get("tiles") is not None:
        df = _tiled(frame, about["tiles"])[0]
    _write_rows(frame, df, path, period=period, mode="overwrite", batch=batch or uuid.uuid4().hex)


def _check_times(frame: Frame, stored: DataFrame, about: dict, period: str, batch: str | None) -> None:
    new = frame.df.select("time").distinct()
    ends = new.agg(F.min(F.date_format("time", PERIODS[period])).alias("a"), F.max(F.date_format("time", PERIODS[period])).alias("b"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return
    # Only the periods that are touched are read, and of them only the times.
    near = stored.where(F.col("_period").cast("string").between(ends["a"], ends["b"]))
    if batch is not None:
        near = near.where(F.col("_batch") != batch)
    if not new.join(near.select("time"), "time", "left_semi").isEmpty():
        raise ValueError("some of the times are in the dataset already")
    if about.get("step") and ends["n"] > 1 and (step := _step(new)) is not None and step != about["step"]:
        raise ValueError(f"the time step is {step} s, the dataset's {about['step']} s")


def read(
    spark: SparkSession,
    path: str,
    *,
    dims: Sequence[str] = ("time",),
    items: str | Sequence[str] | None = None,
    start: str | datetime | None = None,
    stop: str | datetime | None = None,
    geometry: object = None,
    area: Sequence | None = None,
    elements: int | Sequence[int] | None = None,
    layers: str | int | Sequence[str | int] | None = None,
) -> Frame:
    """Read a frame; the choice of items and times reaches the scan, and periods outside the times aren't listed.

    Of a tiled dataset the geometry comes back too, and ``area`` (a box or polygon), ``elements`` and ``layers`` choose among the folders and row groups before they are scanned.
    """
    df = spark.read.parquet(path)
    if "_period" in df.columns:
        text = F.col("_period").cast("string")
        if start is not None:
            df = df.where(text >= F.lit(moment(start)[0].isoformat()).substr(F.lit(1), F.length(text)))
        if stop is not None:
            df = df.where(text <= F.lit(moment(stop, end=True)[0].isoformat()).substr(F.lit(1), F.length(text)))
    if start is not None or stop is not None:
        df = df.where(between(F.col("time"), start, stop))
    about = _about(spark, path) if "_tile" in df.columns else None
    chosen = area is not None or elements is not None or layers is not None
    if chosen and about is None:
        raise ValueError("area, elements and layers can be chosen in tiled datasets only")
    if about is not None:
        dims, geometry = tuple(about["dims"]), geometry or _read_geometry(spark, path, about)
    if chosen:
        df = _pruned(spark, df, path, about, geometry, area, elements, layers)
    known = [c for c in df.columns if c not in (*dims, *_OWN)]
    names = match_items(known, items)
    meta = {f.name: f.metadata for f in df.schema.fields}
    made = [Item(n, meta[n].get("quantity", "Undefined"), meta[n].get("unit", ""), meta[n].get("value_type", "Instantaneous")) for n in names]
    frame = Frame.of(df.select(*dims, *names), dims, made, geometry)
    return _exactly(frame, area, elements, layers) if chosen else frame


def _pruned(spark: SparkSession, df: DataFrame, path: str, about: dict, geometry: object, area: Sequence | None, elements: int | Sequence[int] | None, layers: str | int | Sequence[str | int] | None) -> DataFrame:
    """Filters on folders and sorted columns that leave every chosen row and few others; what is exact follows after the scan."""
    tiling = Tiling(**about["tiling"])
    if area is not None:
        box = area if len(area) == 4 and all(isinstance(v, (int, float)) for v in area) else (min(p[0] for p in area), min(p[1] for p in area), max(p[0] for p in area), max(p[1] for p in area))
        ranges = tiling.ranges(box)
        df = df.where(F.col("_tile").isin(tiling.tiles_of(ranges)))
        df = df.where(reduce(lambda a, b: a | b, (F.col("_key").between(a, b) for a, b in ranges), F.lit(False)))
    if elements is not None:
        wanted = [elements] if isinstance(elements, int) else [int(e) for e in elements]
        keys = [r["_key"] for r in spark.read.parquet(f"{path}/_geometry/places").where(F.col("element").isin(wanted)).select("_key").distinct().collect()]  # as many as the caller listed
        df = df.where(F.col("_tile").isin(tiling.tiles_of([(k, k) for k in keys])) & F.col("_key").isin(keys) & F.col("element").isin(wanted))
    if layers is not None:
        names = [layers] if isinstance(layers, (str, int)) else list(layers)
        n = geometry.n_layers if isinstance(geometry, LayeredMesh) else geometry.axes["z"].n if isinstance(geometry, Grid3D) else 0
        if not n:
            raise ValueError("the dataset has no layers")
        # The lowest layer of a column may have any number.
        if not (isinstance(geometry, LayeredMesh) and "bottom" in names):
            df = df.where(F.col("_layer").isin([{"top": n - 1, "bottom": 0}[w] if isinstance(w, str) else w % n for w in names]))
    return df


def _exactly(frame: Frame, area: Sequence | None, elements: int | Sequence[int] | None, layers: str | int | Sequence[str | int] | None) -> Frame:
    if isinstance(frame.geometry, Grid3D) and layers is not None:
        n = frame.geometry.axes["z"].n
        names = [layers] if isinstance(layers, (str, int)) else list(layers)
        at = [{"top": n - 1, "bottom": 0}[w] if isinstance(w, str) else w for w in names]
        frame, layers = frame.isel(z_idx=at[0] if isinstance(layers, (str, int)) else at), None
    if area is not None or layers is not None:
        frame = frame.sel(area=area, layers=layers)
    return frame if elements is None else frame.isel(element=[elements] if isinstance(elements, int) else list(elements))


@dataclass(frozen=True)
class Header:
    """What is known of a dataset without its values."""

    items: tuple[Item, ...]
    dims: tuple[str, ...]
    geometry: object
    start: datetime | None
    end: datetime | None
    n_steps: int
    timestep: float | None
    datatype: int | None


def open_dataset(spark: SparkSession, path: str, *, dims: Sequence[str] = ("time",)) -> Header:
    """Items, dimensions, geometry and time axis. Of the files only the column of times is read."""
    df = spark.read.parquet(path)
    about = _about(spark, path) or {}
    dims = tuple(about.get("dims", dims))
    items = tuple(Item(f.name, **{k: v for k, v in f.metadata.items() if k in ("quantity", "unit", "value_type")}) for f in df.schema.fields if f.name not in (*dims, *_OWN))
    start = end = None
    n = 0
    if "time" in dims:
        start, end, n = df.select("time").distinct().agg(F.min("time"), F.max("time"), F.count("*")).first()
    geometry = _read_geometry(spark, path, about) if "geometry" in about else None
    return Header(items, dims, geometry, start, end, n, about.get("step"), about.get("datatype"))


def read_many(spark: SparkSession, paths: Sequence[str], **options) -> Frame:
    """Several datasets one after the other; where they overlap the last one counts."""
    return Frame.concat([read(spark, p, **options) for p in paths])


def to_long(frame: Frame) -> DataFrame:
    """A row for each item: dimensions, item, value."""
    return frame.df.unpivot(list(frame.dims), frame.names, "item", "value")


def header(frame: Frame) -> str:
    """Items, dimensions and title as JSON."""
    return json.dumps({"title": frame.title, "dims": frame.dims, "items": [{"name": i.name, **i.metadata()} for i in frame.items]})
