"""Layered meshes: columns of prisms. A table has element, column (the 2D element) and layer (from 0 at the bottom)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.functions.distance import distance
from gridloom.functions.joins import spread
from gridloom.geometry.mesh import centroids
from gridloom.operators import interpolate, mesh, ordering


def columns_of(elements: DataFrame) -> DataFrame:
    """Columns and layers from the connectivity: an element belongs on top of the one before it if its lower face is that one's upper face.

    ``nodes`` holds the lower face's nodes first, then the upper face's; a face of two nodes (of a vertical slice) is walked the other way by the
    element above. Columns are numbered by range partitions with carried counts, so no task sees all elements.
    """
    half = (F.size("nodes") / 2).cast("int")
    faces = elements.select("element", F.slice("nodes", F.lit(1), half).alias("below"), F.slice("nodes", half + 1, half).alias("above"))
    last = F.col("_previous.above")
    joined = F.when(F.size("below") == 2, F.reverse(last)).otherwise(last)
    starts = ordering.with_previous(faces, ["element"], ["above"]).select("element", F.coalesce((joined != F.col("below")).cast("int"), F.lit(1)).alias("new"))
    column = ordering.running_sums(starts, ["element"], {"column": F.col("new")}).select("element", (F.col("column") - 1).cast("int").alias("column"))
    return column.withColumn("layer", (F.row_number().over(W.partitionBy("column").orderBy("element")) - 1).cast("int"))


def aligned(layers: DataFrame, n_layers: int) -> DataFrame:
    """Layers numbered from the top: a column with fewer layers than ``n_layers`` lacks the lowest numbers, as where layers of fixed depth end at the bottom."""
    return layers.withColumn("layer", (F.col("layer") + n_layers - F.count("*").over(W.partitionBy("column"))).cast("int"))


def at_layer(df: DataFrame, layers: DataFrame, layer: str | int | Sequence[str | int]) -> DataFrame:
    """Rows of one layer or of several: "bottom", "top", or numbers from the bottom; negative ones count from the top."""
    numbers = [{"bottom": 0, "top": -1}.get(x, x) for x in ([layer] if isinstance(layer, (str, int)) else layer)]
    if bad := [x for x in numbers if not isinstance(x, int)]:
        raise ValueError(f"no layer {bad[0]!r}")
    wanted = F.col("layer").isin([x for x in numbers if x >= 0])
    if down := [-x for x in numbers if x < 0]:
        layers = layers.withColumn("_down", F.row_number().over(W.partitionBy("column").orderBy(F.desc("layer"))))
        wanted = wanted | F.col("_down").isin(down)
    return df.join(spread(layers.where(wanted).select("element", "column")), "element")


def end_values(df: DataFrame, keys: Sequence[str], items: Sequence[str], *, top: bool = True, layer: str = "layer") -> DataFrame:
    """The items of the uppermost (or lowest) layer of each of ``keys``."""
    pick = F.max_by if top else F.min_by
    row = df.groupBy(*keys).agg(pick(F.struct(*items), F.col(layer)).alias("_row"))
    return row.select(*keys, *(F.col("_row")[i].alias(i) for i in items))


def layers_per_column(layers: DataFrame) -> DataFrame:
    return layers.groupBy("column").agg(F.count("*").cast("int").alias("n_layers"), F.min("element").alias("bottom_element"), F.max("element").alias("top_element"))


def element_z(elements: DataFrame, node_z: DataFrame, keys: Sequence[str] = ("time",)) -> DataFrame:
    """Centre, bottom, top and thickness of each element from z at the nodes (for each of ``keys``)."""
    half = F.size("nodes") / 2
    corners = elements.select("element", half.alias("_h"), F.posexplode("nodes").alias("at", "node")).join(spread(node_z), "node")
    low = F.avg(F.when(F.col("at") < F.col("_h"), F.col("z")))
    high = F.avg(F.when(F.col("at") >= F.col("_h"), F.col("z")))
    return corners.groupBy(*keys, "element").agg(F.avg("z").alias("z"), low.alias("z_bottom"), high.alias("z_top"), (high - low).alias("thickness"))


def depth_mean(df: DataFrame, keys: Sequence[str], items: Sequence[str], thickness: str = "thickness") -> DataFrame:
    """Means over the depth, weighted by thickness."""
    return df.groupBy(*keys).agg(*(nan.agg_average(F.col(i), F.col(thickness)).alias(i) for i in items))


def interp_z(df: DataFrame, keys: Sequence[str], z: str, item: str, levels: Sequence[float]) -> DataFrame:
    """Values at levels within each of ``keys``, linear between neighbours and beyond the ends; one valid point gives itself.

    A group holds the layers of one column, which are few.
    """
    points = F.array_sort(F.collect_list(F.struct(nan.num(z).alias("z"), nan.num(item).alias("v"))))
    grouped = df.groupBy(*keys).agg(points.alias("_p")).withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    p, n = F.col("_p"), F.size("_p")
    below = F.size(F.filter(p, lambda q: q["z"] <= F.col("level")))
    first = F.greatest(F.lit(0), F.least(below - 1, n - 2))
    a, b = F.get(p, first), F.get(p, F.least(first + 1, n - 1))
    value: Column = F.when(n == 1, F.get(p, F.lit(0))["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * nan.divide(F.col("level") - a["z"], b["z"] - a["z"]))
    return grouped.select(*keys, F.col("level").alias(z), value.alias(item))


def lowest_faces(elements: DataFrame, layers: DataFrame) -> DataFrame:
    """The lower faces of the lowest element of each column, numbered by column."""
    bottom = layers.groupBy("column").agg(F.min_by("element", "layer").alias("element"))
    half = (F.size("nodes") / 2).cast("int")
    return elements.join(spread(bottom), "element").select(F.col("column").alias("element"), F.slice("nodes", F.lit(1), half).alias("nodes"))


def to_2d(elements: DataFrame, layers: DataFrame) -> DataFrame:
    """The flat mesh under a layered one: the lower faces of the bottom elements, numbered by column."""
    return lowest_faces(elements, layers)


def in_columns(asked: DataFrame, layers: DataFrame, faces: DataFrame, *, point: str = "point", keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, point, column and element: the element of the column (null if z is outside it) between whose faces z lies.

    ``asked`` has point, column and z, ``faces`` has element, z_bottom and z_top for each of ``keys``. A z on a face belongs to the element below
    it, on the lowest face to the lowest element. Rows of one column meet, never all rows of all columns.
    """
    stacked = layers.select("element", "column").join(spread(faces.select(*keys, "element", "z_bottom", "z_top")), "element")
    lowest = F.min("z_bottom").over(W.partitionBy(*keys, "column"))
    stacked = stacked.withColumn("_floor", lowest)
    inside = (F.col("_z") <= F.col("z_top")) & ((F.col("_z") > F.col("z_bottom")) | ((F.col("_z") == F.col("z_bottom")) & (F.col("z_bottom") == F.col("_floor"))))
    rows = asked.select(point, "column", F.col("z").alias("_z"))
    met = rows.join(spread(stacked), "column", "left").groupBy(*keys, point, "column").agg(F.min(F.when(inside, F.col("element"))).alias("element"))
    return met


def find_elements(points: DataFrame, nodes: DataFrame, elements: DataFrame, layers: DataFrame, *, point: str = "point", node_z: DataFrame | None = None, keys: Sequence[str] = ("time",)) -> DataFrame:
    """point, column and element: the element of the column at (x, y) between whose faces z lies; nulls outside the mesh or the column.

    With ``node_z`` (``keys``, node, z) the faces move and there is a row for each of ``keys``.
    """
    column = mesh.find_elements(points, nodes, to_2d(elements, layers), point=point).withColumnRenamed("element", "column")
    asked = points.select(point, "z").join(spread(column), point)
    moving = list(keys) if node_z is not None else []
    faces = element_z(elements, nodes.select("node", "z") if node_z is None else node_z, keys=moving)
    found = in_columns(asked.where("column is not null"), layers, faces, point=point, keys=moving)
    if not moving:
        return points.select(point).join(spread(found), point, "left")
    times = node_z.select(*moving).distinct()
    outside = asked.where("column is null").select(point, "column", F.lit(None).cast(elements.schema["element"].dataType).alias("element"))
    return found.unionByName(outside.join(times).select(*found.columns))


def nearest_column(points: DataFrame, nodes: DataFrame, elements: DataFrame, layers: DataFrame, *, point: str = "point") -> DataFrame:
    """point and column: the column of a vertical slice whose top element is nearest to (x, y)."""
    tops = centroids(nodes, at_layer(elements, layers, "top").select("element", "nodes"))
    near = interpolate.nearest(points, tops, 1, point=point)
    return near.select(point, "element").join(spread(layers.select("element", "column")), "element").select(point, "column")


def face_z(elements: DataFrame, layers: DataFrame, node_z: DataFrame, keys: Sequence[str] = ("time",)) -> DataFrame:
    """``keys``, column, and three arrays from the bottom up: ze (centres), zf (faces, one more) and zee (centres with both end faces).

    A column has few layers, so its arrays are short; columns and ``keys`` are spread over tasks.
    """
    z = element_z(elements, node_z, keys=list(keys)).join(spread(layers.select("element", "column", "layer")), "element")
    row = z.groupBy(*keys, "column").agg(F.array_sort(F.collect_list(F.struct("layer", "z", "z_bottom", "z_top"))).alias("_of"))
    of = lambda name: F.transform("_of", lambda s: s[name])
    top = F.array(F.element_at("_of", -1)["z_top"])
    low = F.array(F.element_at("_of", 1)["z_bottom"])
    return row.select(*keys, "column", of("z").alias("ze"), F.concat(of("z_bottom"), top).alias("zf"), F.concat(low, of("z"), top).alias("zee"))


def distance_along(nodes: DataFrame, elements: DataFrame, *, is_geo: bool = False) -> DataFrame:
    """element and distance: the way along the centres of a vertical slice's elements in their order, from its first node.

    Steps are summed up within range partitions, with the sums of earlier ranges carried over.
    """
    first = nodes.agg(F.min_by(F.struct("x", "y"), "node").alias("p")).select(F.col("p.x").alias("_x0"), F.col("p.y").alias("_y0"))
    centres = centroids(nodes, elements).select("element", "x", "y").join(F.broadcast(first))  # one row
    before = F.coalesce(F.col("_previous"), F.struct(F.col("_x0").alias("x"), F.col("_y0").alias("y")))
    step = distance(before["x"], before["y"], F.col("x"), F.col("y"), is_geo=is_geo)
    stepped = ordering.with_previous(centres, ["element"], ["x", "y"]).select("element", "x", "y", step.alias("_step"))
    return ordering.running_sums(stepped, ["element"], {"distance": F.col("_step")}).select("element", "x", "y", "distance")


def nearest_distance_along(points: DataFrame, along: DataFrame, *, point: str = "point") -> DataFrame:
    """point and distance: that of the element of :func:`distance_along` whose centre is nearest."""
    near = interpolate.nearest(points, along, 1, point=point).select(point, "element")
    return near.join(spread(along.select("element", "distance")), "element").select(point, "distance")


def surface_elevation(elements: DataFrame, nodes: DataFrame, layers: DataFrame, node_z: DataFrame, *, k: int = 4, keys: Sequence[str] = ("time",)) -> DataFrame:
    """``keys``, element and elevation: z of the ``k`` nearest nodes of the surface at the centres of the top elements, by inverse distance.

    ``node_z`` has ``keys``, node and z. Neighbours are looked for once, not once a step.
    """
    half = (F.size("nodes") / 2).cast("int")
    faces = at_layer(elements, layers, "top").select("element", F.slice("nodes", half + 1, half).alias("nodes"))
    centres = centroids(nodes, faces).select(F.col("element").alias("point"), "x", "y")
    surface = nodes.join(spread(faces.select(F.explode("nodes").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("element"), "x", "y")
    weights = interpolate.idw_weights(interpolate.nearest(centres, surface, k))
    values = node_z.select(*keys, F.col("node").alias("element"), F.col("z").alias("elevation"))
    return interpolate.apply_weights(values, weights, ["elevation"], keys=list(keys)).withColumnRenamed("point", "element")
