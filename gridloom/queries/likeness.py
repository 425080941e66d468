"""Queries that bring one data set onto the cells and times of another, each with its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.geometry.grid import Axis, Grid1D, Grid2D
from gridloom.geometry.mesh import TableMesh
from gridloom.queries import datasets as ds
from gridloom.queries.catalogue import _CENTRED, T, query
from gridloom.queries.datasets import out, sql_out


def _field(spark: SparkSession, sf: str) -> Frame:
    """Three hourly steps over the mesh of the parts."""
    nodes, elements = ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)
    steps = spark.range(3).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id)").alias("time"), F.col("id").alias("_k"))
    values = elements.select("element").join(F.broadcast(steps)).select("time", "element", (F.col("element") % 17 + F.col("_k") * (F.col("element") % 5)).cast("double").alias("value"))
    return Frame.of(values, ("time", "element"), geometry=TableMesh(nodes, elements))


def _on(points: str, cells: str) -> str:
    """IDW of the three nearest centres at points (p, x, y and ``cells``), at steps k of an hour."""
    return f"""SELECT k, {cells}, sum((element % 17 + k * (element % 5)) / (d * d)) / sum(1 / (d * d)) AS value FROM (
  SELECT p.*, e.element, sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y)) AS d FROM {points} p, {_CENTRED} e QUALIFY row_number() OVER (PARTITION BY p.p ORDER BY d, e.element) <= 3), (SELECT unnest(range(0, 3)) AS k) GROUP BY ALL"""


_HOUR = "epoch_us(TIMESTAMP '2024-01-01') + (k * 3600000000)::BIGINT"
_GRID_POINTS = "(SELECT j * 5 + i AS p, i AS x_idx, j AS y_idx, (4.13 + 1.7 * i)::DOUBLE AS x, (1.11 + 0.9 * j)::DOUBLE AS y FROM (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 3)) AS j))"


@query(f"SELECT {_HOUR} AS time, y_idx::INT AS y_idx, x_idx::INT AS x_idx, {sql_out('value')} AS value FROM ({_on(_GRID_POINTS, 'y_idx, x_idx')})")
def like_grid(spark, sf):
    done = _field(spark, sf).interp_like(Grid2D(Axis(4.13, 1.7, 5), Axis(1.11, 0.9, 3)), n_nearest=3, extrapolate=True)
    return done.df.select(T(), "y_idx", "x_idx", out("value").alias("value"))


_OTHER = "(SELECT s_suppkey AS p, s_suppkey AS cell, (4.2 + s_suppkey % 7 * 1.3)::DOUBLE AS x, (1.2 + s_suppkey // 7 % 4 * 0.6)::DOUBLE AS y FROM supplier)"


def _other(spark: SparkSession, sf: str) -> Frame:
    """A mesh of triangles whose centres are spread by the suppliers' numbers, at half past the hours."""
    key = F.col("s_suppkey")
    x, y = (4.2 + key % 7 * 1.3).cast("double"), (1.2 + F.floor(key / 7) % 4 * 0.6).cast("double")
    s = ds.table(spark, sf, "supplier").select(key.cast("int").alias("element"), x.alias("x"), y.alias("y"))
    corner = lambda i, dx, dy: F.struct((F.col("element") * 3 + i).alias("node"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("code"))
    nodes = s.select(F.inline(F.array(corner(0, -0.25, -0.125), corner(1, 0.25, -0.125), corner(2, 0.0, 0.25))))
    elements = s.select("element", F.array(*(F.col("element") * 3 + i for i in range(3))).alias("nodes"))
    times = spark.range(2).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id, 30)").alias("time"))
    return Frame.of(elements.select("element").join(F.broadcast(times)).select("time", "element", F.lit(0.0).alias("none")), ("time", "element"), geometry=TableMesh(nodes, elements))


@query(f"""WITH v AS ({_on(_OTHER, 'cell')})
SELECT epoch_us(TIMESTAMP '2024-01-01 00:30:00') + (a.k * 3600000000)::BIGINT AS time, a.cell::INT AS element, {sql_out('(a.value + b.value) / 2')} AS value FROM v a JOIN v b ON a.cell = b.cell AND b.k = a.k + 1""")
def like_mesh_and_times(spark, sf):
    done = _field(spark, sf).interp_like(_other(spark, sf), n_nearest=3, extrapolate=True)
    return done.df.select(T(), F.col("element").cast("int").alias("element"), out("value").alias("value"))


_LINE = "(SELECT * FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS time, l_linenumber - 1 AS x_idx, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY time) = 7)"


def _line(spark: SparkSession, sf: str) -> Frame:
    """Quantities by month along a line of seven line numbers, of the months that have all of them."""
    li = ds.table(spark, sf, "lineitem")
    by = li.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), (F.col("l_linenumber") - 1).alias("x_idx")).agg(F.sum("l_quantity").alias("quantity"))
    whole = by.groupBy("time").count().where("count = 7").select("time")
    return Frame.of(by.join(whole, "time", "left_semi"), ("time", "x_idx"), geometry=Grid1D(Axis(100.0, 10.0, 7)))


@query(f"""WITH a AS (SELECT m, 0.25 + 0.7 * m AS f FROM (SELECT unnest(range(0, 9)) AS m))
SELECT epoch_us(p.time) AS time, m::INT AS x_idx, {sql_out('p.quantity + (q.quantity - p.quantity) * (f - floor(f))')} AS quantity FROM a JOIN {_LINE} p ON p.x_idx = floor(f) JOIN {_LINE} q ON q.time = p.time AND q.x_idx = floor(f) + 1""")
def like_line(spark, sf):
    """Nine cells between the centres of a line of seven."""
    done = _line(spark, sf).interp_like(Grid1D(Axis(102.5, 7.0, 9)))
    return done.df.select(T(), "x_idx", out("quantity").alias("quantity"))


@query(f"SELECT {_HOUR} AS time, {sql_out('value')} AS value FROM ({_on('(SELECT 0 AS p, 7.1::DOUBLE AS x, 1.9::DOUBLE AS y)', 'p')})")
def interp_mesh_point(spark, sf):
    return _field(spark, sf).interp(x=7.1, y=1.9, n_nearest=3, extrapolate=True).df.select(T(), out("value").alias("value"))


@query(f"SELECT epoch_us(a.time) AS time, {sql_out('a.quantity * 0.75 + b.quantity * 0.25')} AS quantity FROM {_LINE} a JOIN {_LINE} b USING (time) WHERE a.x_idx = 2 AND b.x_idx = 3")
def interp_line_point(spark, sf):
    return _line(spark, sf).interp(x=122.5).df.select(T(), out("quantity").alias("quantity"))


_FAR = "(SELECT c_custkey AS point, ((c_custkey * 37 % 101) * 3 - 150)::DOUBLE AS x, ((c_custkey * 53 % 97) * 2 - 90)::DOUBLE AS y FROM customer)"


@query(f"""SELECT point, element, {sql_out('d', 5)} AS distance, r::INT AS rank FROM (SELECT p.point, e.element, sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y)) AS d,
  row_number() OVER (PARTITION BY p.point ORDER BY round(sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y)), 9), e.element) AS r FROM {_FAR} p, {_CENTRED} e) WHERE r <= 2""")
def nearest_from_afar(spark, sf):
    """Most of the points lie far outside the mesh."""
    from gridloom.geometry.mesh import centroids
    from gridloom.operators import interpolate

    key = F.col("c_custkey")
    points = ds.table(spark, sf, "customer").select(key.alias("point"), (key * 37 % 101 * 3 - 150).cast("double").alias("x"), (key * 53 % 97 * 2 - 90).cast("double").alias("y"))
    near = interpolate.nearest(points, centroids(ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)), 2)
    return near.select("point", "element", out("distance", 5).alias("distance"), "rank")
