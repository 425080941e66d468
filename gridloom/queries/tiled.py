"""Queries on datasets that are written with tiles and read again in part, and on datasets that grow, each with its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.geometry.grid import Axis, Grid2D, Grid3D
from gridloom.geometry.mesh import TableMesh
from gridloom.queries import datasets as ds
from gridloom.queries.catalogue import _CENTRED, T, query
from gridloom.queries.datasets import out, sql_out
from gridloom.queries.layers import _VALUES, _rows, _values
from gridloom.sources import layout
from gridloom.sources.shared import new_path


def _written(f: Frame, tiles: int = 2) -> str:
    path = new_path(f.df.sparkSession, "tiled")
    layout.write(f, path, period="year", tiles=tiles)
    return path


def _mesh_values(spark: SparkSession, sf: str) -> Frame:
    nodes, elements = ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)
    steps = spark.range(2).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id)").alias("time"), F.col("id").alias("_k"))
    values = elements.select("element").join(F.broadcast(steps)).select("time", "element", (F.col("element") * 2.0 + F.col("_k")).alias("value"))
    return Frame.of(values, ("time", "element"), geometry=TableMesh(nodes, elements))


_MESH = f"(SELECT element, x, y, element * 2.0 + k AS value, epoch_us(TIMESTAMP '2024-01-01' + k * INTERVAL 1 HOUR) AS time FROM {_CENTRED}, (SELECT unnest([0, 1]) AS k))"


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_MESH} WHERE x BETWEEN 3 AND 9 AND y BETWEEN 1 AND 3")
def read_area_of_mesh(spark, sf):
    return _rows(layout.read(spark, _written(_mesh_values(spark, sf)), area=(3, 1, 9, 3)))


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_MESH} WHERE x > 2.05 AND y > 0.53 AND y < 4.03 AND x + 2 * y < 14.07")
def read_polygon_of_mesh(spark, sf):
    return _rows(layout.read(spark, _written(_mesh_values(spark, sf)), area=[(2.05, 0.53), (13.01, 0.53), (6.01, 4.03), (2.05, 4.03)]))


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_MESH} WHERE element IN (21, 25, 62)")
def read_elements_of_mesh(spark, sf):
    return _rows(layout.read(spark, _written(_mesh_values(spark, sf)), elements=[21, 25, 62]))


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_VALUES} WHERE x BETWEEN 2 AND 9 AND y BETWEEN 0 AND 1.5 AND (layer = 2 OR layer = 3)")
def read_layers_of_area(spark, sf):
    return _rows(layout.read(spark, _written(_values(spark, sf)), area=(2, 0, 9, 1.5), layers=["top", 2]))


_GRID = "(SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS time, floor((l_quantity - 1) / 5)::INT AS y_idx, l_linenumber - 1 AS x_idx, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)"


def _grid(spark: SparkSession, sf: str) -> Frame:
    """Quantities by year, tens of quantity and line number; their sums are exact."""
    li = ds.table(spark, sf, "lineitem")
    y = F.floor((F.col("l_quantity") - 1) / 5).cast("int")
    g = li.groupBy(F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("time"), y.alias("y_idx"), (F.col("l_linenumber") - 1).alias("x_idx")).agg(F.sum("l_quantity").alias("quantity"))
    return Frame.of(g, ("time", "y_idx", "x_idx"), geometry=Grid2D(Axis(100.0, 10.0, 7), Axis(3.0, 5.0, 10)))


@query(f"SELECT epoch_us(time) AS time, y_idx - 2 AS y_idx, x_idx - 2 AS x_idx, {sql_out('quantity')} AS quantity FROM {_GRID} WHERE x_idx BETWEEN 2 AND 4 AND y_idx BETWEEN 2 AND 7 AND year(time) >= 1995")
def read_area_of_grid(spark, sf):
    return layout.read(spark, _written(_grid(spark, sf)), area=(115, 10, 145, 40), start="1995").df.select(T(), "y_idx", "x_idx", out("quantity").alias("quantity"))


_CUBE = "(SELECT (l_linenumber - 1)::INT AS x_idx, floor((l_quantity - 1) / 5)::INT AS y_idx, (l_suppkey % 4)::INT AS z_idx, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)"


def _cube(spark: SparkSession, sf: str) -> Frame:
    """Quantities by line number, quantity and supplier: a grid of three axes without time."""
    li = ds.table(spark, sf, "lineitem")
    y = F.floor((F.col("l_quantity") - 1) / 5).cast("int")
    g = li.groupBy((F.col("l_suppkey") % 4).cast("int").alias("z_idx"), y.alias("y_idx"), (F.col("l_linenumber") - 1).alias("x_idx")).agg(F.sum("l_quantity").alias("quantity"))
    return Frame.of(g, ("z_idx", "y_idx", "x_idx"), geometry=Grid3D(Axis(100.0, 10.0, 7), Axis(3.0, 5.0, 10), Axis(0.0, 1.0, 4)))


@query(f"SELECT y_idx, x_idx, {sql_out('quantity')} AS quantity FROM {_CUBE} WHERE z_idx = 3")
def read_top_of_cube(spark, sf):
    return layout.read(spark, _written(_cube(spark, sf)), layers="top").df.select("y_idx", "x_idx", out("quantity").alias("quantity"))


@query(f"SELECT z_idx - 1 AS z_idx, y_idx, x_idx - 2 AS x_idx, {sql_out('quantity')} AS quantity FROM {_CUBE} WHERE z_idx >= 1 AND x_idx BETWEEN 2 AND 5")
def isel_cube(spark, sf):
    return _cube(spark, sf).isel(z_idx=slice(1, None), x_idx=[2, 3, 4, 5]).df.select("z_idx", "y_idx", "x_idx", out("quantity").alias("quantity"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('n')} AS n FROM {ds.DAILY}")
def append_again(spark, sf):
    """A batch that is appended a second time under its name takes its own place."""
    path, f = new_path(spark, "appended"), Frame.of(ds.daily(spark, sf))
    layout.write(f.sel(time=slice(None, "1995")), path, period="year")
    layout.append(f.sel(time=slice("1996", "1996")), path, batch="of 1996")
    layout.append(f.sel(time=slice("1997", None)), path)
    layout.append(f.sel(time=slice("1996", "1996")), path, batch="of 1996")
    return layout.read(spark, path, items="n").df.select(T(), out("n").alias("n"))


@query(f"SELECT count(*) AS n_steps, epoch_us(min(time)) AS start, epoch_us(max(time)) AS stop, 'price,n' AS items, 7 AS datatype FROM {ds.DAILY}")
def dataset_header(spark, sf):
    """What is known of a dataset without its values, after it got another tag."""
    path, f = new_path(spark, "header"), Frame.of(ds.daily(spark, sf)).rename({"total": "price"})
    layout.write(f, path, period="year")
    layout.change_datatype(spark, path, 7)
    h = layout.open_dataset(spark, path)
    ends = [F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")) for t in (h.start, h.end)]
    return spark.range(1).select(F.lit(h.n_steps).cast("long").alias("n_steps"), ends[0].alias("start"), ends[1].alias("stop"), F.lit(",".join(i.name for i in h.items)).alias("items"), F.lit(h.datatype).alias("datatype"))


@query(f"""WITH t AS (SELECT o_orderkey AS id, TIMESTAMP '2024-01-01' + INTERVAL 30 MINUTE AS time, (4.2 + o_orderkey % 7 * 1.3)::DOUBLE AS lon, (1.2 + o_orderkey // 7 % 4 * 0.6)::DOUBLE AS lat FROM orders),
n AS (SELECT DISTINCT lon, lat, arg_min(element, (round((lon - x) * (lon - x) + (lat - y) * (lat - y), 9), element)) AS element FROM (SELECT DISTINCT lon, lat FROM t), {_CENTRED} GROUP BY lon, lat)
SELECT id, {sql_out('element * 2.0 + 0.5')} AS value FROM t JOIN n USING (lon, lat)""")
def track_of_columns(spark, sf):
    """A track with columns of other names over a frame's own mesh: all orders, at one time between two steps."""
    key = F.col("o_orderkey")
    lon, lat = (4.2 + key % 7 * 1.3).cast("double"), (1.2 + F.floor(key / 7) % 4 * 0.6).cast("double")
    track = ds.table(spark, sf, "orders").select(key.alias("id"), F.expr("timestamp_ntz'2024-01-01 00:30:00'").alias("when"), lon.alias("lon"), lat.alias("lat"))
    return _mesh_values(spark, sf).extract_track(track, step_seconds=3600, columns=("when", "lon", "lat")).select("id", out("value").alias("value"))
