"""Queries on grids, meshes and axes as geometries, text files, and frames by place, each with its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.functions.joins import spread
from gridloom.geometry.grid import Axis, Grid2D, logarithmic_frequencies
from gridloom.geometry.mesh import TableMesh, centroids
from gridloom.geometry.spectrum import PointSpectrum
from gridloom.operators import mesh
from gridloom.operators.ordering import numbered
from gridloom.plans import pipeline
from gridloom.queries import datasets as ds
from gridloom.queries.catalogue import _CENTRED, T, query
from gridloom.queries.datasets import out, sql_out
from gridloom.queries.tiled import _CUBE, _GRID, _cube, _grid
from gridloom.sources import text
from gridloom.sources.shared import new_path

# grids over points that are spread by the suppliers' numbers

_POINTS = "(SELECT s_suppkey AS point, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y FROM supplier)"
_BOX = f"(SELECT min(x) AS l, min(y) AS b, (max(x) - min(x)) / 4 AS dx, (max(y) - min(y)) / 8 AS dy FROM {_POINTS})"


def _points(spark: SparkSession, sf: str):
    key = F.col("s_suppkey")
    return ds.table(spark, sf, "supplier").select(key.alias("point"), (key * 37 % 101).cast("double").alias("x"), (key * 53 % 97).cast("double").alias("y"))


def _box_grid(spark: SparkSession, sf: str) -> Grid2D:
    e = _points(spark, sf).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return Grid2D.in_box(e, nx=4, ny=8)


@query(f"""SELECT j * 4 + i AS cell, {sql_out('l + (i + 0.5) * dx', 9)} AS x, {sql_out('b + (j + 0.5) * dy', 9)} AS y, count(point) AS n
FROM {_BOX} CROSS JOIN (SELECT unnest(range(0, 4)) AS i) CROSS JOIN (SELECT unnest(range(0, 8)) AS j) LEFT JOIN {_POINTS} p ON least(floor((p.x - l) / dx), 3) = i AND least(floor((p.y - b) / dy), 7) = j GROUP BY ALL""")
def points_in_cells(spark, sf):
    """A grid in the points' box, and how many points each of its cells has."""
    g = _box_grid(spark, sf)
    held = _points(spark, sf).select(*(c.alias(n) for n, c in g.find_cells(x=F.col("x"), y=F.col("y")).items())).groupBy("x_idx", "y_idx").agg(F.count("*").alias("n"))
    return g.cells(spark).join(held, ["x_idx", "y_idx"], "left").select("cell", out("x", 9).alias("x"), out("y", 9).alias("y"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"SELECT j * 5 + i AS node, {sql_out('l + i * dx', 9)} AS x, {sql_out('b + j * dy', 9)} AS y FROM {_BOX} CROSS JOIN (SELECT unnest(range(0, 5)) AS i) CROSS JOIN (SELECT unnest(range(0, 9)) AS j)")
def grid_nodes(spark, sf):
    """The corners of all cells, of a grid that is made of its own lines again."""
    g = _box_grid(spark, sf)
    again = Grid2D.of_nodes(g.x.edges.tolist(), g.y.edges.tolist())
    return again.nodes(spark).select("node", out("x", 9).alias("x"), out("y", 9).alias("y"))


@query(f"""SELECT (j * 4 + i)::INT AS element, array_to_string([j * 5 + i, j * 5 + i + 1, j * 5 + i + 6, j * 5 + i + 5], ',') AS nodes, {sql_out('dx * dy', 6)} AS area
FROM {_BOX} CROSS JOIN (SELECT unnest(range(0, 4)) AS i) CROSS JOIN (SELECT unnest(range(0, 8)) AS j)""")
def grid_to_mesh(spark, sf):
    table = _box_grid(spark, sf).to_mesh().as_tables(spark)
    areas = mesh.element_area(table.nodes, table.elements)
    return table.elements.join(areas, "element").select("element", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), out("area").alias("area"))


@query("SELECT (j * 5 + i)::INT AS node, CASE WHEN j = 0 AND i > 0 THEN 3 WHEN j = 8 AND i < 4 THEN 5 WHEN i = 0 THEN 2 WHEN i = 4 THEN 4 ELSE 0 END::INT AS code, (SELECT count(*) FROM supplier) AS n FROM (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 9)) AS j)")
def side_codes(spark, sf):
    """Codes of the sides of the mesh of a grid around the points."""
    table = _box_grid(spark, sf).to_mesh().as_tables(spark)
    return table.nodes.join(_points(spark, sf).agg(F.count("*").alias("n"))).select("node", "code", "n")


@query(f"""WITH e AS (SELECT min(x) - 1 AS l, min(y) - 1 AS b, (max(x) - min(x) + 2) / 6 AS dx, (max(y) - min(y) + 2) / 5 AS dy FROM {ds.NODES})
SELECT least(floor((x - l) / dx), 5)::INT AS x_idx, least(floor((y - b) / dy), 4)::INT AS y_idx, count(*) AS n FROM {_CENTRED}, e GROUP BY ALL""")
def overset_counts(spark, sf):
    """Elements by the cells of a grid that covers their mesh with a margin."""
    table = TableMesh(ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf))
    g = table.overset_grid(nx=6, ny=5, buffer=1.0)
    cells = g.find_cells(x=F.col("x"), y=F.col("y"))
    return centroids(table.nodes, table.elements).select(*(c.alias(n) for n, c in cells.items())).groupBy("x_idx", "y_idx").agg(F.count("*").alias("n"))


# frames by place

@query(f"SELECT epoch_us(time) AS time, x_idx - 1 AS x_idx, {sql_out('quantity')} AS quantity FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS step FROM {_GRID}) WHERE step BETWEEN 1 AND 3 AND y_idx = 2 AND x_idx >= 1")
def by_places(spark, sf):
    return _grid(spark, sf)[1:4, 2, 1:].df.select(T(), "x_idx", out("quantity").alias("quantity"))


@query(f"SELECT {sql_out('100 + 10 * x_idx')} AS x, {sql_out('sum(quantity) / count(*)')} AS quantity FROM {_GRID} GROUP BY x_idx")
def mean_over_rows(spark, sf):
    """What is left of a grid without its rows and times is a line."""
    f = _grid(spark, sf).mean(["time", "y_idx"])
    return f.df.join(f.geometry.x.table(spark, "x"), "x_idx").select(out("x").alias("x"), out("quantity").alias("quantity"))


@query(f"SELECT {sql_out('quantity')} AS quantity FROM {_CUBE} WHERE x_idx = 3 AND y_idx = 4 AND z_idx = 2")
def sel_cube_point(spark, sf):
    return _cube(spark, sf).sel(x=131.0, y=24.9, z=1.6).df.select(out("quantity").alias("quantity"))


@query(f"SELECT epoch_us((SELECT min(time) FROM {_GRID})) AS time, {sql_out('max(quantity)')} AS quantity FROM {_GRID}")
def first_stamp(spark, sf):
    """A reduction over everything that keeps the first time."""
    return _grid(spark, sf).aggregate("max", None, keep_first_time=True).df.select(T(), out("quantity").alias("quantity"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('total - n / 2', 4)} AS less_half FROM {ds.DAILY}")
def function_of_items(spark, sf):
    def less_half(values):
        return values[0] - values[1] / 2

    f = Frame.of(ds.daily(spark, sf)).aggregate(less_half, "items")
    return f.df.select(T(), out("less_half", 4).alias("less_half"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('CASE WHEN n > 5 THEN n END')} AS n FROM {ds.DAILY}")
def masked_items(spark, sf):
    f = Frame.of(ds.daily(spark, sf))[["n"]]
    return f[F.col("n") > 5].df.select(T(), out("n").alias("n"))


@query("SELECT event_id, round(CASE WHEN event_id % 9 = 4 THEN -1 ELSE value END, 6) AS value FROM events")
def filled_corrupt(spark, sf):
    """Values that can't be read as numbers become a stated one."""
    e = ds.table(spark, sf, "events")
    broken = e.select("event_id", F.when(F.col("event_id") % 9 == 4, F.lit("##")).otherwise(F.col("value").cast("string")).try_cast("double").alias("value"))
    return pipeline.fill_corrupt(broken, ["value"], -1.0).select("event_id", F.round("value", 6).alias("value"))


# spectra by their axes


@query(f"""WITH f AS (SELECT i, pow(1.1, i) * 0.055 AS f FROM (SELECT unnest(range(0, 8)) AS i))
SELECT point, direction_idx * 45.0::DOUBLE AS direction, {sql_out('sum(energy * f * (1.1 - 1 / 1.1) / 2)', 9)} AS energy FROM {ds.SPECTRA} JOIN f ON i = frequency_idx GROUP BY point, direction_idx""")
def energy_by_direction(spark, sf):
    """Energies over the widths of a logarithmic frequency axis."""
    g = PointSpectrum(tuple(logarithmic_frequencies(8)), tuple(45.0 * i for i in range(8)))
    axes = g.axis_tables(spark)
    rows = ds.spectra(spark, sf).join(F.broadcast(axes["frequency"]), "frequency_idx").join(F.broadcast(axes["direction"]), "direction_idx")  # eight rows each
    return rows.groupBy("point", "direction").agg(F.sum(F.col("energy") * F.col("width")).alias("energy")).select("point", "direction", out("energy", 9).alias("energy"))


# text files


@query(f"SELECT element, array_to_string(nodes, ',') AS nodes, {sql_out('sx', 6)} AS x, code FROM (SELECT e.element, any_value(e.nodes) AS nodes, sum(m.x) AS sx, sum(m.code)::BIGINT AS code FROM (SELECT (row_number() OVER (ORDER BY element) - 1)::INT AS element, nodes FROM {ds.ELEMENTS}) e JOIN (SELECT * FROM {ds.NODES}) m ON list_contains(e.nodes, m.node) GROUP BY e.element)")
def mesh_file_round_trip(spark, sf):
    """The mesh of the parts, its elements numbered from 0, is written as a mesh file and read again."""
    nodes = ds.mesh_nodes(spark, sf)
    moved = numbered(ds.mesh_elements(spark, sf), ["element"], "new")
    elements = moved.select(F.col("new").cast("int").alias("element"), "nodes")
    path = new_path(spark, "mesh")
    text.write_mesh_tables(TableMesh(nodes, elements, "UTM-33"), path)
    back = text.read_mesh_tables(spark, path)
    back.check()
    corners = back.elements.select("element", "nodes", F.explode("nodes").alias("node")).join(spread(back.nodes), "node")
    sums = corners.groupBy("element", "nodes").agg(F.sum("x").alias("x"), F.sum("code").alias("code"))
    return sums.select("element", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), out("x").alias("x"), "code")


@query("SELECT point, x, y, CASE WHEN point % 3 = 0 THEN 'by ' || point END AS label FROM (SELECT s_suppkey AS point, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y FROM supplier)")
def xyz_round_trip(spark, sf):
    """Points with labels written as text and read again."""
    p = _points(spark, sf)
    line = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"), F.col("point").cast("string"), F.when(F.col("point") % 3 == 0, F.concat(F.lit("by "), F.col("point").cast("string"))))
    path = new_path(spark, "xyz")
    p.select(line.alias("value")).write.text(path)
    return text.read_xyz(spark, path).select(F.col("z").cast("long").alias("point"), "x", "y", "label")


@query(f"SELECT epoch_us(time) AS time, {sql_out('total', 2)} AS total, {sql_out('n')} AS n FROM {ds.DAILY}")
def csv_round_trip(spark, sf):
    """A series written as CSV with a number for what is missing, and read again."""
    d = ds.daily(spark, sf)
    path = new_path(spark, "csv")
    d.select(F.date_format("time", "yyyy-MM-dd").alias("Date"), F.nanvl("total", F.lit(-99.99)).alias("Total"), F.col("n").alias("N")).write.option("header", True).csv(path)
    back = text.read_series_csv(spark, path, "Date", ["Total", "N"], missing=[-99.99])
    return back.select(T(), out("Total", 2).alias("total"), out("N").alias("n"))
