"""Queries on layered meshes with uneven layers, on vertical slices and on spectra over lines and areas, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.functions.joins import spread
from gridloom.geometry.layered import LayeredMesh
from gridloom.geometry.mesh import TableMesh
from gridloom.geometry.spectrum import AreaSpectrum, LineSpectrum
from gridloom.operators import layered
from gridloom.queries import datasets as ds
from gridloom.queries.catalogue import query
from gridloom.queries.datasets import out, sql_out

# The parts as prisms, four to a column; faces at 0, 1, 3, 6 and 10, a part of an eighth higher from column to column. All numbers are exact in binary.

_E = "(SELECT p_partkey::INT AS element, (p_partkey // 4)::INT AS c, (p_partkey % 4)::INT AS l FROM part)"
_FACE = lambda f: f"(({f}) * (({f}) + 1) / 2 + c % 7 * 0.125)::DOUBLE"
_PRISMS = f"""(SELECT element, c, l, (dense_rank() OVER (ORDER BY c) - 1)::INT AS col, (4 - count(*) OVER (PARTITION BY c) + row_number() OVER (PARTITION BY c ORDER BY element) - 1)::INT AS layer,
  {_FACE('l')} AS low, {_FACE('l + 1')} AS high, row_number() OVER (PARTITION BY c ORDER BY element) = 1 AS is_lowest FROM {_E})"""
_XY = "(c % 25 + 0.375)::DOUBLE AS x, (c // 25 + 0.25)::DOUBLE AS y"


def uneven(spark: SparkSession, sf: str) -> LayeredMesh:
    """Corners of a column at (0, 0), (0.875, 0.125) and (0.25, 0.625) from its place."""
    key = F.col("p_partkey")
    lower = (F.floor(key / 4) * 100 + key % 4 * 3).cast("int")
    elements = ds.table(spark, sf, "part").select(key.cast("int").alias("element"), F.array(*(lower + i for i in range(6))).alias("nodes"))
    node = F.col("node")
    c, f, k = F.floor(node / 100), F.floor(node % 100 / 3), node % 100 % 3
    x = c % 25 + F.when(k == 0, 0.0).when(k == 1, 0.875).otherwise(0.25)
    y = F.floor(c / 25) + F.when(k == 0, 0.0).when(k == 1, 0.125).otherwise(0.625)
    z = f * (f + 1) / 2 + c % 7 * 0.125
    nodes = elements.select(F.explode("nodes").alias("node")).distinct().select("node", x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), F.lit(0).alias("code"))
    return LayeredMesh.of(nodes, elements)


def _values(spark: SparkSession, sf: str) -> Frame:
    g = uneven(spark, sf)
    steps = spark.range(3).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id)").alias("time"), F.col("id").alias("_k"))
    values = g.elements.select("element").join(F.broadcast(steps)).select("time", "element", (F.col("element") * 8 + F.col("_k")).cast("double").alias("value"))
    return Frame.of(values, ("time", "element"), geometry=g)


_VALUES = f"(SELECT p.*, epoch_us(TIMESTAMP '2024-01-01' + k * INTERVAL 1 HOUR) AS time, (element * 8 + k)::DOUBLE AS value FROM (SELECT *, {_XY} FROM {_PRISMS}) p, (SELECT unnest([0, 1, 2]) AS k))"


def _rows(f: Frame) -> DataFrame:
    from gridloom.queries.catalogue import T

    return f.df.select(T(), "element", out("value").alias("value"))


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_VALUES} WHERE layer = 1 OR layer = 3 OR is_lowest")
def sel_layers(spark, sf):
    return _rows(_values(spark, sf).sel(layers=["bottom", 1, -1]))


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_VALUES} WHERE x BETWEEN 2 AND 9 AND y BETWEEN 0 AND 1.5")
def sel_layered_area(spark, sf):
    return _rows(_values(spark, sf).sel(area=(2, 0, 9, 1.5)))


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_VALUES} WHERE x BETWEEN 2 AND 9 AND y BETWEEN 0 AND 1.5 AND layer IN (0, 2)")
def sel_layers_in_area(spark, sf):
    return _rows(_values(spark, sf).sel(area=(2, 0, 9, 1.5), layers=[0, 2]))


@query(f"SELECT time, {sql_out('value')} AS value FROM {_VALUES} WHERE c = 3 AND 3.5 > low AND 3.5 <= high")
def sel_z(spark, sf):
    from gridloom.queries.catalogue import T

    return _values(spark, sf).sel(x=3.25, y=0.25, z=3.5).df.select(T(), out("value").alias("value"))


@query(f"SELECT time, element, {sql_out('value')} AS value FROM {_VALUES} WHERE c = 3")
def sel_column(spark, sf):
    return _rows(_values(spark, sf).sel(x=3.25, y=0.25))


@query(f"SELECT element, array_to_string([c * 100 + l * 3 + k FOR k IN [0, 1, 2]], ',') AS nodes FROM (SELECT *, {_XY} FROM {_PRISMS}) WHERE layer = 2 AND x <= 6")
def one_layer_is_flat(spark, sf):
    """The geometry of one layer is a flat mesh with the elements' ids."""
    geometry = _values(spark, sf).sel(area=(-1, -1, 6, float("inf")), layers=2).geometry
    assert isinstance(geometry, TableMesh)
    return geometry.elements.select("element", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


_ASKED = "(SELECT s_suppkey AS point, (s_suppkey % 5 + 1)::INT AS c, (s_suppkey * 7 % 97 / 8.0 - 0.5)::DOUBLE AS z, s_suppkey % 4 = 0 AS outside FROM supplier)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Points in five columns at eighths of a metre, so that some lie on faces, some below and above; a quarter of them beside the mesh."""
    key = F.col("s_suppkey")
    x = F.when(key % 4 == 0, F.lit(-5.0)).otherwise(key % 5 + 1 + 0.375)
    return ds.table(spark, sf, "supplier").select(key.alias("point"), x.cast("double").alias("x"), F.lit(0.25).alias("y"), (key * 7 % 97 / 8 - 0.5).cast("double").alias("z"))


@query(f"""SELECT a.point, CASE WHEN NOT outside THEN p.col END AS "column", CASE WHEN NOT outside THEN max(CASE WHEN z <= high AND (z > low OR (z = low AND is_lowest)) THEN element END) END AS element
FROM {_ASKED} a JOIN {_PRISMS} p USING (c) GROUP BY a.point, outside, p.col""")
def find_layered_element(spark, sf):
    g = uneven(spark, sf)
    return layered.find_elements(_asked(spark, sf), g.nodes, g.elements, g.layers).select("point", "column", "element")


def _moving(g: LayeredMesh) -> DataFrame:
    """z of the nodes at four hours: a quarter of a metre higher each."""
    steps = g.nodes.sparkSession.range(4).select(F.col("id").alias("hour"))
    return g.nodes.select("node", "z").join(F.broadcast(steps)).select("hour", "node", (F.col("z") + F.col("hour") * 0.25).alias("z"))


@query(f"""SELECT h.hour, a.point, CASE WHEN NOT outside THEN p.col END AS "column",
  CASE WHEN NOT outside THEN max(CASE WHEN z <= high + hour * 0.25 AND (z > low + hour * 0.25 OR (z = low + hour * 0.25 AND is_lowest)) THEN element END) END AS element
FROM {_ASKED} a JOIN {_PRISMS} p USING (c), (SELECT unnest(range(4)) AS hour) h GROUP BY h.hour, a.point, outside, p.col""")
def find_moving_element(spark, sf):
    g = uneven(spark, sf)
    return layered.find_elements(_asked(spark, sf), g.nodes, g.elements, g.layers, node_z=_moving(g), keys=["hour"]).select("hour", "point", "column", "element")


_ROUNDED = "array_to_string(list_transform({}, lambda v: round(v * 1000)::BIGINT), ',')"
_LISTS = f"(SELECT hour, col, list((low + high) / 2 + hour * 0.25 ORDER BY l) AS ze, list(low + hour * 0.25 ORDER BY l) AS lo, max(high) + hour * 0.25 AS top FROM {_PRISMS}, (SELECT unnest(range(4)) AS hour) GROUP BY hour, col)"


@query(f"""SELECT hour, col AS "column", {_ROUNDED.format('ze')} AS ze, {_ROUNDED.format('list_append(lo, top)')} AS zf, {_ROUNDED.format('list_append(list_prepend(lo[1], ze), top)')} AS zee FROM {_LISTS}""")
def moving_layers(spark, sf):
    g = uneven(spark, sf)
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 1000).cast("long").cast("string")), ",").alias(c)
    return layered.face_z(g.elements, g.layers, _moving(g), keys=["hour"]).select("hour", "column", text("ze"), text("zf"), text("zee"))


# A vertical slice: columns stand beside each other along a bent line, quadrilaterals of two nodes below and two above.

_SLICE = "(SELECT p_partkey::INT AS element, (p_partkey // 4)::INT AS c FROM part)"
_MID = "((2 * c + 1) * 1.5)::DOUBLE AS x, (((c % 3) + (c + 1) % 3) * 2.0)::DOUBLE AS y"
_ALONG = f"""(SELECT element, x, y, sum(step) OVER (ORDER BY element) AS distance FROM (SELECT element, x, y,
  sqrt(pow(x - coalesce(lag(x) OVER w, (SELECT 3.0 * min(c) FROM {_SLICE})), 2) + pow(y - coalesce(lag(y) OVER w, (SELECT 4.0 * (min(c) % 3) FROM {_SLICE})), 2)) AS step
  FROM (SELECT element, {_MID} FROM {_SLICE}) WINDOW w AS (ORDER BY element)))"""


def _slice(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Node c * 10 + f stands at the left of column c; faces are walked to the right below and back above."""
    key = F.col("p_partkey")
    c, f = F.floor(key / 4), key % 4
    node = lambda i, j: ((c + i) * 10 + f + j).cast("int")
    elements = ds.table(spark, sf, "part").select(key.cast("int").alias("element"), F.array(node(0, 0), node(1, 0), node(1, 1), node(0, 1)).alias("nodes"))
    at, level = F.floor(F.col("node") / 10), F.col("node") % 10
    nodes = elements.select(F.explode("nodes").alias("node")).distinct().select("node", (at * 3.0).alias("x"), (at % 3 * 4.0).alias("y"), (level * 2.0).alias("z"), F.lit(0).alias("code"))
    return nodes, elements


@query(f"SELECT element, {sql_out('distance', 4)} AS distance FROM {_ALONG}")
def distance_along_slice(spark, sf):
    return layered.distance_along(*_slice(spark, sf)).select("element", out("distance", 4).alias("distance"))


@query(f"""WITH p AS (SELECT s_suppkey AS point, (s_suppkey * 29 % 83)::DOUBLE AS px, (s_suppkey * 13 % 7)::DOUBLE AS py FROM supplier)
SELECT point, {sql_out('arg_min(distance, (round(pow(x - px, 2) + pow(y - py, 2), 9), element))', 4)} AS distance FROM p, {_ALONG} GROUP BY point""")
def nearest_along_slice(spark, sf):
    key = F.col("s_suppkey")
    points = ds.table(spark, sf, "supplier").select(key.alias("point"), (key * 29 % 83).cast("double").alias("x"), (key * 13 % 7).cast("double").alias("y"))
    return layered.nearest_distance_along(points, layered.distance_along(*_slice(spark, sf))).select("point", out("distance", 4).alias("distance"))


@query(f"SELECT element, c - (SELECT min(c) FROM {_SLICE}) AS \"column\" FROM {_SLICE} WHERE c IN (5, 7)")
def profile_columns(spark, sf):
    nodes, elements = _slice(spark, sf)
    g = LayeredMesh.of(nodes, elements, is_profile=True)
    mid = lambda c: (spark, (2 * c + 1) * 1.5, (c % 3 + (c + 1) % 3) * 2.0)
    ids = g.point_elements(*mid(5)).union(g.point_elements(*mid(7)))
    return g.layers.join(spread(ids), "element", "left_semi").select("element", "column")


# Spectra of the first eight vectors' numbers along a line, and of all vectors over the mesh of the parts.

_DIRECTIONS = tuple(i * 0.785398163397448 for i in range(8))
_FREQUENCIES = tuple(0.05 * 1.1**i for i in range(8))


def _line(spark: SparkSession, sf: str) -> Frame:
    n = ds.table(spark, sf, "embeddings").count()
    g = LineSpectrum(_FREQUENCIES, _DIRECTIONS, nodes=tuple((float(i), 0.0) for i in range(n))).in_degrees("radian")
    return Frame.of(ds.spectra(spark, sf).withColumnRenamed("point", "node"), ("node", "direction_idx", "frequency_idx"), geometry=g)


@query(f"SELECT point AS node, direction_idx, frequency_idx, {sql_out('energy')} AS energy FROM {ds.SPECTRA} WHERE point IN (3, 4, 5, 9)")
def sel_line_nodes(spark, sf):
    return _line(spark, sf).sel(node=[3, 4, 5, 9]).df.select("node", "direction_idx", "frequency_idx", out("energy").alias("energy"))


@query(f"SELECT 7.0::DOUBLE AS x, 45.0::DOUBLE AS degrees, frequency_idx, {sql_out('energy')} AS energy FROM {ds.SPECTRA} WHERE point = 7 AND direction_idx = 1")
def sel_line_point(spark, sf):
    """A node of a line is a point; directions were given in radians."""
    f = _line(spark, sf).sel(node=7)
    one = f.df.where("direction_idx = 1")
    return one.select(F.lit(f.geometry.x).alias("x"), F.lit(round(f.geometry.directions[1], 9)).alias("degrees"), "frequency_idx", out("energy").alias("energy"))


def _area(spark: SparkSession, sf: str) -> Frame:
    nodes, elements = ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)
    g = AreaSpectrum(_FREQUENCIES, tuple(45.0 * i for i in range(8)), mesh=TableMesh(nodes, elements))
    rows = ds.spectra(spark, sf).withColumnRenamed("point", "element").join(spread(elements.select("element")), "element", "left_semi")
    return Frame.of(rows, ("element", "direction_idx", "frequency_idx"), geometry=g)


_AREA = f"""(SELECT s.*, avg(m.x) AS x, avg(m.y) AS y FROM {ds.SPECTRA} s JOIN (SELECT element, unnest(nodes) AS node FROM {ds.ELEMENTS}) e ON e.element = s.point JOIN {ds.NODES} m USING (node) GROUP BY ALL)"""


@query(f"SELECT point AS element, direction_idx, frequency_idx, {sql_out('energy')} AS energy FROM {_AREA} WHERE x BETWEEN 3 AND 9 AND y BETWEEN 1 AND 3")
def sel_spectral_area(spark, sf):
    return _area(spark, sf).sel(area=(3, 1, 9, 3)).df.select("element", "direction_idx", "frequency_idx", out("energy").alias("energy"))


@query(f"SELECT direction_idx, frequency_idx, {sql_out('energy')} AS energy, {sql_out('x')} AS x, {sql_out('y')} AS y FROM {_AREA} WHERE point = 25")
def sel_spectral_point(spark, sf):
    """The element that holds a point; what is left is a point spectrum at its centre."""
    f = _area(spark, sf).sel(x=5.7, y=0.9)
    return f.df.select("direction_idx", "frequency_idx", out("energy").alias("energy"), out(F.lit(f.geometry.x)).alias("x"), out(F.lit(f.geometry.y)).alias("y"))


@query(f"SELECT point AS element, {sql_out('sum(energy)')} AS energy FROM {ds.SPECTRA} WHERE point IN (21, 22, 30) GROUP BY point")
def sel_spectral_elements(spark, sf):
    f = _area(spark, sf).sel(element=[21, 22, 30])
    return f.df.groupBy("element").agg(F.sum("energy").alias("energy")).select("element", out("energy").alias("energy"))
