"""Findings of round 3: joins of growing tables stay out of the driver, bins fit bands and lines, places and edges are exact."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.geometry.grid import Axis
from gridloom.operators import interpolate
from gridloom.queries import QUERIES
from gridloom.queries import datasets as ds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["depth_mean", "find_layered_element", "find_moving_element", "moving_layers", "nearest_from_afar", "regrid_weights", "surface_elevation", "boundary_rings", "boundary_polygons", "nearest_along_slice", "profile_columns"])
def test_growing_tables_are_not_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "_range" not in line]  # one row a range


@pytest.mark.parametrize(("kind", "stacked"), [("band", 1), ("line", 4)])
def test_neighbours_on_bands_and_lines(spark, kind, stacked):
    """Most of the box is empty; the bins are those of the places in use."""
    i, j = F.col("id") % 20, F.floor(F.col("id") / 20)
    x, y = (i + j * 0.5, j * 2.0) if kind == "band" else (F.floor(F.col("id") / stacked) * 3.0, F.floor(F.col("id") / stacked) % 3 * 2.0)
    elements = spark.range(8000).select(F.col("id").alias("element"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    b = elements.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    size = interpolate._bin_size(elements, b, 8000, 2, "x", "y")
    assert elements.groupBy(F.floor((F.col("x") - b[0]) / size), F.floor((F.col("y") - b[1]) / size)).count().agg(F.max("count")).first()[0] <= 64
    points = spark.range(60).select(F.col("id").alias("point"), (F.col("id") % 20 * 41.3 - 100).alias("x"), (F.col("id") % 20 * 17.1 - 50).alias("y"))
    got = {(r["point"], r["rank"]): r["element"] for r in interpolate.nearest(points, elements, 2).collect()}
    rows = elements.collect()
    for p in points.collect():
        want = sorted((math.sqrt((p["x"] - e["x"]) ** 2 + (p["y"] - e["y"]) ** 2), e["element"]) for e in rows)[:2]
        assert [got[p["point"], 1], got[p["point"], 2]] == [e for _, e in want]


def test_mesh_places_are_exact(spark):
    """Every x and y of the mesh is the double that the SQL's decimal has; sums of rounded steps aren't."""
    sf = "/root/testdata/sf0.01"
    got = sorted((r["node"], r["x"], r["y"]) for r in ds.mesh_nodes(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    assert got == con.execute(f"SELECT node, x, y FROM {ds.NODES} ORDER BY node").fetchall()


def test_outer_edges_are_those_given():
    for n in range(1, 200):
        a = Axis.spanning(-1.1, n * 0.7 + 6.3, n=n)
        assert (a.left, a.right) == (-1.1, n * 0.7 + 6.3)


def test_one_layer_of_a_long_mesh(spark, tmp_path):
    spark.range(100_000, 100_400).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["one_layer_is_flat"](spark, str(tmp_path))
    assert found.count() == 4 * 6  # six columns of each of four rows, all beyond y = 1000


def test_documents_are_parsed_once(spark):
    plan = QUERIES["document_aliases"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "BroadcastHashJoin" not in plan
