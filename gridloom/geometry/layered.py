"""Layered meshes of any size: prisms in columns, as tables. A selection is a semi-join through the table of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.joins import spread
from gridloom.geometry.base import Geometry0D, OutsideDomainError, Point3D
from gridloom.geometry.mesh import TableMesh, centroids
from gridloom.operators import layered, mesh
from gridloom.sources.shared import stored


@dataclass(frozen=True, eq=False)
class LayeredMesh:
    """Nodes (node, x, y, z, code), elements (element, nodes) and layers (element, column, layer).

    Layers are numbered from the bottom, and columns that have fewer than ``n_layers`` lack the lowest numbers. Elements and columns keep their ids in
    selections. ``is_profile`` marks a vertical slice, whose elements are quadrilaterals that stand on an edge.
    """

    nodes: DataFrame
    elements: DataFrame
    layers: DataFrame
    n_layers: int
    projection: str = "LONG/LAT"
    is_profile: bool = False
    dims: tuple[str, ...] = field(default=("element",))

    @classmethod
    def of(cls, nodes: DataFrame, elements: DataFrame, projection: str = "LONG/LAT", *, is_profile: bool = False) -> LayeredMesh:
        """Columns and layers are found by the connectivity, once: the table is stored, as every selection joins it several times."""
        found = stored(layered.columns_of(elements), "layers")
        n = (found.agg(F.max("layer")).first()[0] or 0) + 1
        return cls(nodes, elements, layered.aligned(found, n), n, projection, is_profile)

    def as_tables(self, spark: SparkSession) -> LayeredMesh:
        return self

    def reduce(self, dims: Sequence[str]) -> LayeredMesh | Geometry0D:
        return Geometry0D() if "element" in dims or "space" in dims else self

    def flat(self) -> TableMesh:
        """The mesh of the columns; its elements are numbered as they are."""
        elements = layered.lowest_faces(self.elements, self.layers)
        return TableMesh(self._used(elements), elements, self.projection)

    to_2d = flat

    def write_mesh(self, path: str) -> None:
        """The mesh of the columns as a mesh file, its nodes and elements numbered anew."""
        from gridloom.sources.text import write_mesh_tables

        flat = self.flat()
        nodes, elements = mesh.renumber(flat.nodes, flat.elements)
        write_mesh_tables(TableMesh(nodes, elements, self.projection), path)

    def contains(self, points: DataFrame, *, point: str = "point") -> DataFrame:
        """Whether a column holds each point's (x, y)."""
        flat = self.flat()
        return mesh.contains(points, flat.nodes, flat.elements, point=point)

    def _used(self, elements: DataFrame) -> DataFrame:
        return self.nodes.join(spread(elements.select(F.explode("nodes").alias("node"))), "node", "left_semi")

    # elements by layer and place, as tables with the column element

    def layer_elements(self, wanted: str | int | Sequence[str | int]) -> DataFrame:
        """Elements of layers: "bottom" and "top" of each column, or numbers from 0 to ``n_layers`` - 1; negative ones count from the top."""
        names = [wanted] if isinstance(wanted, (str, int)) else list(wanted)
        numbers, bottom = [], False
        for w in names:
            if w == "bottom":
                bottom = True
            elif w == "top":
                numbers.append(self.n_layers - 1)
            elif isinstance(w, int) and -self.n_layers <= w < self.n_layers:
                numbers.append(w % self.n_layers)
            else:
                raise ValueError(f"no layer {w!r}; there are {self.n_layers}")
        found = self.layers.where(F.col("layer").isin(numbers)).select("element")
        if bottom:
            found = found.union(self.layers.groupBy("column").agg(F.min_by("element", "layer").alias("element")).select("element")).distinct()
        return found

    def area_elements(self, area: Sequence) -> DataFrame:
        """Elements of the columns whose centre lies in a box or polygon."""
        if self.is_profile:
            raise ValueError("a vertical slice has no area")
        flat = self.flat()
        columns = mesh.elements_in(flat.nodes, flat.elements, area).withColumnRenamed("element", "column")
        return self.layers.join(spread(columns), "column", "left_semi").select("element")

    def point_elements(self, spark: SparkSession, x: float, y: float, z: float | None = None) -> DataFrame:
        """The elements of the column at a point, or the one between whose faces z lies. OutsideDomainError outside the mesh or the column."""
        point = spark.range(1).select(F.col("id").alias("point"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z or 0)).alias("z"))
        if self.is_profile:
            column = layered.nearest_column(point, self.nodes, self.elements, self.layers)
        else:
            flat = self.flat()
            column = mesh.find_elements(point, flat.nodes, flat.elements).withColumnRenamed("element", "column")
        at = column.first()["column"]
        if at is None:
            raise OutsideDomainError(x, y)
        there = self.layers.where(F.col("column") == at)
        if z is None:
            return there.select("element")
        faces = layered.element_z(self.elements.join(there, "element", "left_semi"), self.nodes.select("node", "z"), keys=[])
        found = layered.in_columns(point.select("point", "z", F.lit(at).alias("column")), there, faces).first()["element"]
        if found is None:
            raise OutsideDomainError(x, y, z)
        return there.where(F.col("element") == found).select("element")

    # geometries of some elements

    def keep(self, ids: DataFrame) -> LayeredMesh | TableMesh | Point3D:
        """The geometry of the elements in ``ids``: a point for one, a flat mesh for one layer (or only bottom elements), else a layered mesh."""
        layers = self.layers.join(spread(ids.select("element")), "element", "left_semi")
        lowest = self.layers.groupBy("column").agg(F.min("layer").alias("_low"))
        n = layers.join(spread(lowest), "column").agg(F.count("*").alias("n"), F.min("layer").alias("low"), F.max("layer").alias("high"), F.min((F.col("layer") == F.col("_low")).cast("int")).alias("bottom"), F.count_distinct("column").alias("columns"), F.first("element").alias("one")).first()
        elements = self.elements.join(spread(layers), "element", "left_semi")
        if n["n"] == 1:
            c = centroids(self.nodes, elements).first()
            return Point3D(c["x"], c["y"], c["z"])
        if n["n"] and not self.is_profile and (n["low"] == n["high"] or (n["bottom"] == 1 and n["columns"] > 1)):
            half = (F.size("nodes") / 2).cast("int")
            faces = elements.select("element", F.slice("nodes", F.lit(1), half).alias("nodes"))
            return TableMesh(self._used(faces), faces, self.projection)
        return replace(self, nodes=self._used(elements), elements=elements, layers=layers)
