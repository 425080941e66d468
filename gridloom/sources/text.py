"""Text formats: meshes, points with values, CSV series with a value for "missing", all read line by line by Spark.

:func:`read_mesh` keeps a small mesh on the driver; :func:`read_mesh_tables` and :func:`write_mesh_tables` never bring more than its header there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.geometry.mesh import Mesh, TableMesh
from gridloom.operators.ordering import numbered


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and a label that may be missing, separated by blanks or tabs."""
    parts = F.split(F.trim("value"), r"\s+", 4)
    return spark.read.text(path).where(F.trim("value") != "").select(*(F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")), F.get(parts, F.lit(3)).alias("label"))


def read_series_csv(spark: SparkSession, path: str, time: str, items: Sequence[str], *, time_format: str | None = None, missing: Sequence[float] = ()) -> DataFrame:
    """time and items of a CSV file with a header; ``missing`` values become NaN."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    stamp = F.to_timestamp_ntz(F.col(time), F.lit(time_format)) if time_format else F.col(time).cast("timestamp_ntz")
    value = lambda c: F.when(F.col(c).try_cast("double").isin([float(m) for m in missing]), F.lit(nan.NAN)).otherwise(nan.or_nan(F.col(c).try_cast("double"))).alias(c)
    return raw.select(stamp.alias("time"), *map(value, items))


def parse_mesh(lines: Sequence[str]) -> Mesh:
    """A mesh of its text: a header, the nodes (number x y z code), a header, the elements (number and nodes from 1; 0 fills up)."""
    head = lines[0].split()
    numbers = [w for w in head if w.lstrip("-").isdigit()]
    n = int(numbers[-1])
    projection = lines[0].split(str(n), 1)[1].strip() if len(numbers) == 1 else lines[0].strip().rsplit(f" {n} ", 1)[-1].strip()
    rows = np.array([line.split()[1:5] for line in lines[1 : n + 1]], dtype=float)
    n_elements = int(lines[n + 1].split()[0])
    elements = [[int(w) - 1 for w in line.split()[1:] if int(w) > 0] for line in lines[n + 2 : n + 2 + n_elements]]
    if len(rows) != n or len(elements) != n_elements:
        raise ValueError("the mesh ends before its last element")
    return Mesh(rows[:, :3], elements, rows[:, 3].astype(int), projection)


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    """A mesh file from any store that Spark reads. A mesh is a dimension table; it is kept on the driver."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"no mesh in {path}")
    return parse_mesh([line for line in text[0].splitlines() if line.strip()])


def format_mesh(mesh: Mesh) -> str:
    codes = np.zeros(len(mesh.nodes), dtype=int) if mesh.codes is None else mesh.codes
    width = mesh.max_nodes_per_element
    lines = [f"100079 1000 {len(mesh.nodes)} {mesh.projection}"]
    lines += [f"{i} {float(x)!r} {float(y)!r} {float(z)!r} {int(c)}" for i, ((x, y, z), c) in enumerate(zip(mesh.nodes, codes, strict=True), 1)]
    lines.append(f"{len(mesh.elements)} {width} {21 if width == 3 else 25}")
    lines += [" ".join(map(str, [i, *(n + 1 for n in e), *[0] * (width - len(e))])) for i, e in enumerate(mesh.elements, 1)]
    return "\n".join(lines) + "\n"


def write_mesh(spark: SparkSession, mesh: Mesh, path: str) -> None:
    """As one text part in the folder ``path``."""
    spark.createDataFrame([(format_mesh(mesh).rstrip("\n"),)], "value string").coalesce(1).write.text(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0) and value of the lines that aren't blank: by file, place of the split in it, and line of the split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return numbered(lines.where(F.trim("value") != ""), ["_f", "_b", "_i"]).select("number", "value")


def read_mesh_tables(spark: SparkSession, path: str) -> TableMesh:
    """A mesh file (or folder of parts in order) of any size as tables. Lines are numbered by range partitions; only the two headers reach the driver."""
    lines = _numbered_lines(spark, path)
    head = lines.where("number = 0").first()
    if head is None:
        raise ValueError(f"no mesh in {path}")
    words = head["value"].split()
    numbers = [w for w in words if w.lstrip("-").isdigit()]
    n = int(numbers[-1])
    projection = head["value"].strip().split(str(n), 1)[1].strip() if len(numbers) == 1 else head["value"].strip().rsplit(f" {n} ", 1)[-1].strip()
    second = lines.where(F.col("number") == n + 1).first()
    if second is None:
        raise ValueError("the mesh ends before its elements")
    n_elements = int(second["value"].split()[0])
    parts = F.split(F.trim("value"), r"\s+")
    word = lambda i, kind: F.get(parts, F.lit(i)).try_cast(kind)  # noqa: E731  (filters on the number may run after it)
    nodes = lines.where(F.col("number").between(1, n)).select((word(0, "int") - 1).alias("node"), word(1, "double").alias("x"), word(2, "double").alias("y"), word(3, "double").alias("z"), word(4, "int").alias("code"))
    corners = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda w: w.try_cast("int") - 1), lambda i: i >= 0)
    elements = lines.where(F.col("number").between(n + 2, n + 1 + n_elements)).select((word(0, "int") - 1).alias("element"), corners.alias("nodes"))
    if lines.where(F.col("number") == n + 1 + n_elements).isEmpty():
        raise ValueError("the mesh ends before its last element")
    return TableMesh(nodes, elements, projection)


def write_mesh_tables(mesh: TableMesh, path: str) -> None:
    """As text parts in the folder ``path``, which are one mesh file when put one behind the other. Ids are those of the tables and have to be dense from 0."""
    spark = mesh.nodes.sparkSession
    n, (n_elements, width) = mesh.nodes.count(), mesh.elements.agg(F.count("*"), F.max(F.size("nodes"))).first()
    width = width or 3
    text = lambda *c: F.concat_ws(" ", *(x.cast("string") for x in c))
    heads = spark.createDataFrame([(0, f"100079 1000 {n} {mesh.projection}"), (n + 1, f"{n_elements} {width} {21 if width == 3 else 25}")], "number long, value string")
    nodes = mesh.nodes.select((F.col("node") + 1).cast("long").alias("number"), text(F.col("node") + 1, F.col("x"), F.col("y"), F.col("z"), F.coalesce("code", F.lit(0))).alias("value"))
    filled = F.concat(F.transform("nodes", lambda i: i + 1), F.array_repeat(F.lit(0), F.lit(width) - F.size("nodes")))
    elements = mesh.elements.select((F.col("element") + n + 2).cast("long").alias("number"), text(F.col("element") + 1, F.array_join(filled.cast("array<string>"), " ")).alias("value"))
    every = heads.unionByName(nodes).unionByName(elements)
    every.repartitionByRange("number").sortWithinPartitions("number").select("value").write.text(path)
