"""Queries on items and axes, layered meshes, connectivity and parameter documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.functions.joins import spread
from gridloom.geometry.grid import Axis, Grid2D
from gridloom.operators import aggregate, layered, mesh
from gridloom.queries import datasets as ds
from gridloom.queries.catalogue import _CORNERS, _NEXT, _PROBES, T, _documents, query
from gridloom.queries.datasets import out, sql_out
from gridloom.sources import layout, params
from gridloom.sources.shared import new_path

# items and axes


def _grid(spark: SparkSession, sf: str) -> Frame:
    return Frame.of(ds.grid2(spark, sf), ("time", "y_idx", "x_idx"), geometry=Grid2D(Axis(100.0, 10.0, 7), Axis(3.0, 5.0, 10)))


@query(f"SELECT epoch_us(time) AS time, 9 - y_idx AS y_idx, x_idx, {sql_out('price', 4)} AS price FROM {ds.GRID2}")
def flip_rows(spark, sf):
    return _grid(spark, sf).flipud().df.select(T(), "y_idx", "x_idx", out("price", 4).alias("price"))


@query(f"SELECT epoch_us(time) AS time, y_idx, {sql_out('price', 4)} AS price FROM {ds.GRID2} WHERE x_idx = 2")
def squeeze_axis(spark, sf):
    return _grid(spark, sf).isel(x_idx=[2]).squeeze().df.select(T(), "y_idx", out("price", 4).alias("price"))


@query(f"SELECT epoch_us(time) AS time, y_idx, x_idx, {sql_out('price', 4)} AS cost, {sql_out('price * 2', 4)} AS twice FROM {ds.GRID2}")
def insert_and_rename(spark, sf):
    f = _grid(spark, sf)
    f = f.insert(0, "twice", F.col("price") * 2).rename({"price": "cost"}).with_item("none", F.lit(0.0)).drop("none")
    return f.df.select(T(), "y_idx", "x_idx", *(out(n, 4).alias(n) for n in f.names))


@query(f"SELECT epoch_us(time) AS time, item, {sql_out('value')} AS value FROM (SELECT time, unnest(['total', 'n']) AS item, unnest([total, n]) AS value FROM {ds.DAILY})")
def long_rows(spark, sf):
    return layout.to_long(Frame.of(ds.daily(spark, sf))).select(T(), "item", out("value").alias("value"))


@query(f"SELECT x_idx, {sql_out('max(discount) - min(discount)')} AS discount FROM {ds.GRID1} GROUP BY x_idx")
def apply_function(spark, sf):
    f = Frame.of(ds.grid1(spark, sf), ("time", "x_idx"))[["discount"]]
    return f.apply(lambda v: float(v.max() - v.min())).df.select("x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('n')} AS n FROM {ds.DAILY} WHERE time >= '1995-03-01' AND time < '1996-08-01'")
def layout_round_trip(spark, sf):
    """Two parts are written one after the other, and some months and one item of them read again."""
    path = new_path(spark, "layout")
    f = Frame.of(ds.daily(spark, sf))
    layout.write(f.sel(time=slice(None, "1995")), path)
    layout.append(f.sel(time=slice("1996", None)), path)
    return layout.read(spark, path, items="n", start="1995-03", stop="1996-07").df.select(T(), out("n").alias("n"))


# layered meshes: the parts as prisms, four to a column

_PRISMS = "(SELECT p_partkey::INT AS element, (p_partkey // 4)::INT AS c, (p_partkey % 4)::INT AS l FROM part)"
_Z = "(1.5 * l + 1.0 + c % 7 * 0.1)"
_LAYERS = f"(SELECT element, c, l, (dense_rank() OVER (ORDER BY c) - 1)::INT AS col, (row_number() OVER (PARTITION BY c ORDER BY element) - 1)::INT AS layer, {_Z} AS z FROM {_PRISMS})"
_CORNER = "(SELECT unnest([0, 1, 2]) AS k)"
_X, _Y = "(c % 25 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 0.9 ELSE 0.2 END)::DOUBLE", "(c // 25 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 0.1 ELSE 0.8 END)::DOUBLE"


def _prisms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, x, y, z), elements (element, nodes) and layers (element, column, layer)."""
    key = F.col("p_partkey")
    lower = (F.floor(key / 4) * 100 + key % 4 * 3).cast("int")
    elements = ds.table(spark, sf, "part").select(key.cast("int").alias("element"), F.array(*(lower + i for i in range(6))).alias("nodes"))
    node = F.col("node")
    c, rest = F.floor(node / 100), node % 100
    k = rest % 3
    x = (c % 25 + F.when(k == 0, 0.0).when(k == 1, 0.9).otherwise(0.2)).cast("double")
    y = (F.floor(c / 25) + F.when(k == 0, 0.0).when(k == 1, 0.1).otherwise(0.8)).cast("double")
    z = (F.floor(rest / 3) * 1.5 + k * 0.25 + c % 7 * 0.1).cast("double")
    nodes = elements.select(F.explode("nodes").alias("node")).distinct().select("node", x.alias("x"), y.alias("y"), z.alias("z"))
    return nodes, elements, layered.columns_of(elements)


@query(f'SELECT element, col AS "column", layer FROM {_LAYERS}')
def layered_columns(spark, sf):
    return _prisms(spark, sf)[2]


@query(f'SELECT col AS "column", count(*)::INT AS n_layers, min(element) AS bottom_element, max(element) AS top_element FROM {_LAYERS} GROUP BY col')
def layers_per_column(spark, sf):
    return layered.layers_per_column(_prisms(spark, sf)[2])


@query(f'SELECT element, col AS "column" FROM {_LAYERS} QUALIFY layer = 0 OR row_number() OVER (PARTITION BY col ORDER BY layer DESC) = 2')
def several_layers(spark, sf):
    _, elements, layers = _prisms(spark, sf)
    return layered.at_layer(elements, layers, ["bottom", -2]).select("element", "column")


@query(f'SELECT col AS "column", {sql_out("avg(element)")} AS value FROM {_LAYERS} GROUP BY col')
def depth_mean(spark, sf):
    nodes, elements, layers = _prisms(spark, sf)
    z = layered.element_z(elements, nodes.select("node", "z"), keys=[])  # all layers are 1.5 thick
    values = layers.join(spread(z), "element").withColumn("value", F.col("element").cast("double"))
    return layered.depth_mean(values, ["column"], ["value"]).select("column", out("value").alias("value"))


@query(f"""WITH g AS (SELECT col, list(z ORDER BY z) AS zs, list((element * 37 % 101)::DOUBLE ORDER BY z) AS vs FROM {_LAYERS} GROUP BY col),
q AS (SELECT *, len(zs) AS n, len(list_filter(zs, lambda a: a <= level)) AS b FROM g, (SELECT unnest([0.33, 3.33, 7.77]::DOUBLE[]) AS level)),
w AS (SELECT *, greatest(1, least(b, n - 1)) AS i FROM q)
SELECT col AS "column", level AS z, {sql_out('CASE WHEN n = 1 THEN vs[1] ELSE vs[i] + (vs[i + 1] - vs[i]) * (level - zs[i]) / (zs[i + 1] - zs[i]) END')} AS value FROM w""")
def interp_z(spark, sf):
    nodes, elements, layers = _prisms(spark, sf)
    z = layered.element_z(elements, nodes.select("node", "z"), keys=[])
    values = layers.join(spread(z), "element").withColumn("value", (F.col("element") * 37 % 101).cast("double"))
    return layered.interp_z(values, ["column"], "z", "value", [0.33, 3.33, 7.77]).select("column", "z", out("value").alias("value"))


@query(f"SELECT col AS element, array_to_string([c * 100 + l * 3 + k FOR k IN [0, 1, 2]], ',') AS nodes FROM {_LAYERS} WHERE layer = 0")
def flat_mesh(spark, sf):
    _, elements, layers = _prisms(spark, sf)
    return layered.to_2d(elements, layers).select("element", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(f"""WITH t AS (SELECT element, c, l FROM {_LAYERS} QUALIFY row_number() OVER (PARTITION BY c ORDER BY layer DESC) = 1),
n AS (SELECT c * 100 + (l + 1) * 3 + k AS node, {_X} AS x, {_Y} AS y, (l + 1) * 1.5 + k * 0.25 + c % 7 * 0.1 AS z FROM t, {_CORNER}),
m AS (SELECT element, avg({_X}) AS x, avg({_Y}) AS y FROM t, {_CORNER} GROUP BY element),
d AS (SELECT m.element, n.z, sqrt((m.x - n.x) * (m.x - n.x) + (m.y - n.y) * (m.y - n.y)) AS d, n.node FROM m, n QUALIFY row_number() OVER (PARTITION BY m.element ORDER BY d, n.node) <= 3)
SELECT element, {sql_out('sum(z / (d * d)) / sum(1 / (d * d))')} AS elevation FROM d GROUP BY element""")
def surface_elevation(spark, sf):
    nodes, elements, layers = _prisms(spark, sf)
    found = layered.surface_elevation(elements, nodes, layers, nodes.select("node", "z"), k=3, keys=[])
    return found.select("element", out("elevation").alias("elevation"))


# connectivity


@query(f"""SELECT element, 0 AS part, array_to_string(nodes[1:3], ',') AS nodes FROM {ds.ELEMENTS}
UNION ALL SELECT element, 1, array_to_string([nodes[3], nodes[4], nodes[1]], ',') FROM {ds.ELEMENTS} WHERE len(nodes) = 4""")
def split_quads(spark, sf):
    return mesh.split_quads(ds.mesh_elements(spark, sf)).select("element", "part", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(f"""WITH e AS (SELECT element, nodes FROM {ds.ELEMENTS} WHERE element % 3 = 1),
n AS (SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT unnest(nodes) AS node FROM e)),
c AS (SELECT element, unnest(nodes) AS node, unnest(range(1, len(nodes) + 1)) AS pos FROM e)
SELECT (dense_rank() OVER (ORDER BY element) - 1)::INT AS element, string_agg(i::VARCHAR, ',' ORDER BY pos) AS nodes FROM c JOIN n USING (node) GROUP BY c.element""")
def renumber(spark, sf):
    _, elements = mesh.renumber(ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf).where("element % 3 = 1"))
    return elements.select("element", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(f"""WITH s AS (SELECT p.point, n.element, (n.x2 - n.x) * (p.y - n.y) - (n.y2 - n.y) * (p.x - n.x) AS side FROM {_PROBES} p, {_NEXT} n),
h AS (SELECT point FROM s GROUP BY point, element HAVING min(side) >= 0 OR max(side) <= 0)
SELECT point, point IN (SELECT point FROM h) AS contains FROM {_PROBES}""")
def mesh_contains(spark, sf):
    key = F.col("c_custkey")
    points = ds.table(spark, sf, "customer").select(key.alias("point"), ((key * 37 % 101) / 101.0 * 24 - 1).alias("x"), ((key * 53 % 97) / 97.0 * 40 - 1).alias("y"))
    return mesh.contains(points, ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf))


@query(f"""WITH c AS (SELECT element, avg(x) AS ex, avg(y) AS ey FROM {_CORNERS} GROUP BY element),
p AS (SELECT c_custkey AS point, (c_custkey * 37 % 101) / 101.0 * 12 + 3 AS x, (c_custkey * 53 % 97) / 97.0 + 1.5 AS y FROM customer),
d AS (SELECT point, element, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS d FROM p, c QUALIFY row_number() OVER (PARTITION BY point ORDER BY d, element) <= 4)
SELECT point, element, {sql_out('(1 / (d * d)) / sum(1 / (d * d)) OVER (PARTITION BY point)')} AS weight FROM d""")
def regrid_weights(spark, sf):
    key = F.col("c_custkey")
    points = ds.table(spark, sf, "customer").select(key.alias("point"), ((key * 37 % 101) / 101.0 * 12 + 3).alias("x"), ((key * 53 % 97) / 97.0 + 1.5).alias("y"))
    weights = mesh.regrid_weights(points, ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf), k=4, extrapolate=True)
    return weights.select("point", "element", out("weight").alias("weight"))


# documents of parameters

_POINTS = "SELECT s_suppkey, n, (s_suppkey + n - 1)::BIGINT AS x FROM supplier, (SELECT unnest([1, 2]) AS n)"


@query(f"SELECT s_suppkey::VARCHAR AS doc, 'nation' AS key, CASE WHEN s_nationkey = 3 THEN 99 ELSE s_nationkey END::BIGINT AS value FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'x', CASE WHEN x = 3 THEN 99 ELSE x END FROM ({_POINTS})")
def parameter_replace(spark, sf):
    found = params.find_replace(_documents(spark, sf), 3, 99).where("key IN ('nation', 'x')")
    return found.select("doc", "key", params.value("int").alias("value"))


@query("SELECT s_suppkey::VARCHAR AS doc, CASE WHEN s_suppkey % 2 = 0 AND s_nationkey = 3 THEN 99 ELSE s_nationkey END::BIGINT AS nation FROM supplier")
def parameter_merge(spark, sf):
    base = _documents(spark, sf)
    other = params.find_replace(base.where("cast(doc as long) % 2 = 0"), 3, 99)
    return params.merge(base, other).where("key = 'nation'").select("doc", params.value("int").alias("nation"))


@query("SELECT s_suppkey::VARCHAR AS doc, (s_suppkey + 1)::BIGINT AS x FROM supplier")
def parameter_path(spark, sf):
    return params.at_path(_documents(spark, sf), "S/POINT_2/x").select("doc", params.value("int").alias("x"))


@query("SELECT s_suppkey::VARCHAR AS doc, true AS before, false AS after FROM supplier")
def parameter_delete(spark, sf):
    table = _documents(spark, sf)
    before = params.holds(table, "S/POINT_1").withColumnRenamed("holds", "before")
    return before.join(params.holds(params.without(table, "S/POINT_1"), "S/POINT_1").withColumnRenamed("holds", "after"), "doc")


@query("SELECT s_suppkey::VARCHAR AS doc, true AS is_unique FROM supplier")
def parameter_is_unique(spark, sf):
    return params.is_unique(_documents(spark, sf))


@query(f"SELECT s_suppkey::VARCHAR AS doc, 'S/POINT_' || n AS path, x FROM ({_POINTS})")
def parameter_text_round_trip(spark, sf):
    again = params.parse_documents(params.to_text(_documents(spark, sf)))
    return again.where("key = 'x'").select("doc", F.array_join("path", "/").alias("path"), params.value("int").alias("x"))


# boundaries of a mesh with lakes: quadrilaterals of the parts without a block of cells every six rows, whose middle cell is an island

_LAKE = "(node % 20 BETWEEN 4 AND 9 AND node // 20 % 6 BETWEEN 2 AND 4 AND NOT (node % 20 = 6 AND node // 20 % 6 = 3))"
_QUADS = f"(SELECT node AS element, [node, node + 1, node + 21, node + 20] AS nodes FROM (SELECT p_partkey::INT AS node FROM part WHERE p_partkey % 20 < 19 AND p_partkey + 21 IN (SELECT p_partkey FROM part)) WHERE NOT {_LAKE})"
_RINGS = f"""WITH RECURSIVE d AS (SELECT unnest(nodes) AS a, unnest(list_concat(nodes[2:], nodes[1:1])) AS b FROM {_QUADS}),
f AS (SELECT a, b FROM d ANTI JOIN (SELECT b AS a, a AS b FROM d) USING (a, b)),
walk(origin, spot) AS (SELECT a, b FROM f UNION SELECT origin, f.b FROM walk JOIN f ON f.a = walk.spot),
ring AS (SELECT origin AS node, min(spot) AS ring FROM walk GROUP BY origin),
face AS (SELECT ring, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM f JOIN ring r ON r.node = f.a JOIN {ds.NODES} a ON a.node = f.a JOIN {ds.NODES} b ON b.node = f.b),
poly AS (SELECT ring, count(*) AS n_nodes, sum(xa * yb - xb * ya) / 2 AS area FROM face GROUP BY ring)"""


def _lakes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("node")
    row = F.floor(n / 20) % 6
    lake = (n % 20).between(4, 9) & row.between(2, 4) & ~((n % 20 == 6) & (row == 3))
    parts = ds.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("node"))
    whole = parts.where(n % 20 < 19).join(spread(parts.select((n - 21).alias("node"))), "node", "left_semi").where(~lake)
    return ds.mesh_nodes(spark, sf), whole.select(n.alias("element"), F.array(n, n + 1, n + 21, n + 20).alias("nodes"))


@query(f"""{_RINGS} SELECT p.ring::INT AS ring, p.n_nodes, {sql_out('abs(p.area)')} AS area, p.area > 0 AS is_outer,
  CASE WHEN p.area < 0 THEN (SELECT min(ring) FROM ring)::INT END AS parent FROM poly p""")
def boundary_polygons(spark, sf):
    """Lakes are holes of the one large outline, islands are outlines of their own."""
    rings = mesh.boundary_rings(*_lakes(spark, sf))
    first = lambda c: F.shiftright(c, 32).cast("int")
    return mesh.boundary_polygons(rings).select(first("ring").alias("ring"), "n_nodes", out("area").alias("area"), "is_outer", first("parent").alias("parent"))


@query(f"""{_RINGS} SELECT r.ring::INT AS ring, r.node::INT AS node, (SELECT f.b FROM f WHERE f.a = r.node)::INT AS following FROM ring r""")
def boundary_rings(spark, sf):
    """Each node of a ring with the one that follows it, by their places in the ring."""
    rings = mesh.boundary_rings(*_lakes(spark, sf))
    lists = rings.groupBy("ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda s: s["node"]).alias("of"))
    pairs = F.transform("of", lambda v, i: F.struct(v.alias("node"), F.get("of", (i + 1) % F.size("of")).alias("following")))
    return lists.select(F.shiftright("ring", 32).cast("int").alias("ring"), F.explode(pairs).alias("p")).select("ring", "p.node", "p.following")


# exact quantiles of groups that no task holds

_PRICES = "quantile_cont(l_extendedprice, {})"


@query(f"SELECT l_returnflag, {', '.join(sql_out(_PRICES.format(q), 4) + f' AS q{int(q * 100)}' for q in (0.0, 0.1, 0.5, 0.99, 1.0))} FROM lineitem GROUP BY l_returnflag")
def quantile_of_large_groups(spark, sf):
    found = aggregate.quantile(ds.table(spark, sf, "lineitem"), ["l_returnflag"], ["l_extendedprice"], [0.0, 0.1, 0.5, 0.99, 1.0], most_in_task=1000)
    return found.select("l_returnflag", *(out(F.col(f"`Quantile {q}, l_extendedprice`"), 4).alias(f"q{int(q * 100)}") for q in (0.0, 0.1, 0.5, 0.99, 1.0)))


@query(f"""SELECT 'l_quantity' AS item, count(*)::DOUBLE AS n, {sql_out('quantile_cont(l_quantity, 0.25)', 4)} AS p25, {sql_out('median(l_quantity)', 4)} AS p50, {sql_out('max(l_quantity)')} AS high FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(*), {sql_out('quantile_cont(l_extendedprice, 0.25)', 4)}, {sql_out('median(l_extendedprice)', 4)}, {sql_out('max(l_extendedprice)')} FROM lineitem""")
def describe_large_table(spark, sf):
    d = aggregate.describe(ds.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], [0.25, 0.5], most_in_task=1000)
    return d.select("item", F.col("count").alias("n"), out(F.col("`25%`"), 4).alias("p25"), out(F.col("`50%`"), 4).alias("p50"), out("max").alias("high"))
