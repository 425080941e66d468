"""Layered frames, spectra and tiled datasets beyond the catalogue: errors, bounds, geometries and what a scan reads."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.geometry import AreaSpectrum, LineSpectrum, OutsideDomainError, Point3D, PointSpectrum, TableMesh
from gridloom.geometry.grid import Axis, Grid2D
from gridloom.geometry.layered import LayeredMesh
from gridloom.geometry.tiles import Tiling
from gridloom.operators import layered, ordering, select
from gridloom.sources import layout
from gridloom.sources.shared import new_path


@pytest.fixture(scope="module")
def prisms(spark):
    """Two columns of triangles; layers from 0 to 1 and from 1 to 11 in the first, only the upper one in the second."""
    nodes = [(f * 10 + k, x, y, z, 0) for f, z in ((0, 0.0), (1, 1.0), (2, 11.0)) for k, (x, y) in enumerate(((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)))]
    elements = [(0, [0, 1, 2, 10, 11, 12]), (1, [10, 11, 12, 20, 21, 22]), (2, [11, 13, 12, 21, 23, 22])]
    return LayeredMesh.of(spark.createDataFrame(nodes, "node int, x double, y double, z double, code int"), spark.createDataFrame(elements, "element int, nodes array<int>"))


def test_layers_are_counted_from_the_top(prisms):
    assert {r["element"]: (r["column"], r["layer"]) for r in prisms.layers.collect()} == {0: (0, 0), 1: (0, 1), 2: (1, 1)}
    ids = lambda df: sorted(r["element"] for r in df.collect())
    assert ids(prisms.layer_elements("bottom")) == [0, 2] and ids(prisms.layer_elements("top")) == [1, 2]
    assert ids(prisms.layer_elements(0)) == [0] and ids(prisms.layer_elements([-1])) == [1, 2]
    for bad in (2, -3, "middle"):
        with pytest.raises(ValueError, match="layer"):
            prisms.layer_elements(bad)


def test_z_by_faces(spark, prisms):
    asked = [(0, 0.0, 0), (1, 0.5, 0), (2, 1.0, 0), (3, 2.0, 1), (4, 11.0, 1), (5, 500.0, None), (6, -0.1, None)]
    points = spark.createDataFrame([(p, 0.2, 0.2, z) for p, z, _ in asked], "point int, x double, y double, z double")
    found = {r["point"]: r["element"] for r in layered.find_elements(points, prisms.nodes, prisms.elements, prisms.layers).collect()}
    assert found == {p: e for p, _, e in asked}


def test_frame_of_layers(spark, prisms):
    f = Frame.of(spark.createDataFrame([(datetime(2024, 1, 1), e, float(e)) for e in range(3)], "time timestamp_ntz, element int, value double"), ("time", "element"), geometry=prisms)
    point = f.sel(x=0.2, y=0.2, z=2)
    assert isinstance(point.geometry, Point3D) and point.dims == ("time",) and point.df.first()["value"] == 1.0
    assert isinstance(f.sel(layers="bottom").geometry, TableMesh)
    assert isinstance(f.sel(x=0.2, y=0.2).geometry, LayeredMesh)
    for z in (-1, 12):
        with pytest.raises(OutsideDomainError):
            f.sel(x=0.2, y=0.2, z=z)
    with pytest.raises(OutsideDomainError):
        f.sel(x=5, y=5)
    with pytest.raises(ValueError, match="area or coordinates"):
        f.sel(x=0.2, y=0.2, area=(0, 0, 1, 1))
    with pytest.raises(ValueError, match="x and y"):
        f.sel(z=3)
    assert {r["point"]: r["contains"] for r in prisms.contains(spark.createDataFrame([(0, 0.9, 0.9), (1, 2.0, 2.0)], "point int, x double, y double")).collect()} == {0: True, 1: False}


def test_spectra_by_nodes_and_elements(spark):
    line = LineSpectrum((0.1, 0.2), (0.0, 1.5707963267948966), nodes=((0.0, 0.0), (1.0, 0.0), (2.0, 0.0)))
    assert line.in_degrees("radian").directions[1] == pytest.approx(90) and line.in_degrees("degree") is line
    with pytest.raises(ValueError, match="degree"):
        line.in_degrees("gon")
    assert line.keep([1, 2]).segments == ((1, 2),)
    assert isinstance(line.keep([2]), PointSpectrum) and line.keep([2]).x == 2.0
    with pytest.raises(ValueError, match="neighbours"):
        line.keep([0, 2])
    with pytest.raises(ValueError, match="no node"):
        line.keep([7])
    with pytest.raises(ValueError, match="nodes"):
        line.select(spark, area=(0, 0, 1, 1))
    with pytest.raises(ValueError, match="point spectrum"):
        PointSpectrum((0.1,)).select(spark, node=0)
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "node int, x double, y double, z double")
    area = AreaSpectrum((0.1,), mesh=TableMesh(nodes, spark.createDataFrame([(0, [0, 1, 2])], "element int, nodes array<int>")))
    for bad in ({"area": (5, 5, 6, 6)}, {"element": 3}, {"x": 0.1}, {"node": 1}):
        with pytest.raises(ValueError, match="elements"):
            area.select(spark, **bad)
    with pytest.raises(OutsideDomainError):
        area.select(spark, x=3, y=3)


def test_steps_by_number(spark):
    df = spark.range(8).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id)").alias("time"), "id")
    got = lambda at: sorted(r["id"] for r in select.steps_at(df, at).collect())
    assert got(slice(5, 2, -1)) == [3, 4, 5] and got(slice(None, None, -1)) == list(range(8)) and got(slice(6, None, -3)) == [0, 3, 6]
    assert got(slice(9, 12)) == [] and got(-8) == [0] and got([1, -1]) == [1, 7]
    for bad in (99, [99], -9):
        with pytest.raises(IndexError):
            select.steps_at(df, bad)


def test_order_without_one_task(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), (F.col("id") % 7).alias("v"))
    rows = ordering.numbered(df, ["k"], parts=7).collect()
    assert all(r["k"] == r["number"] for r in rows)
    by = {r["k"]: r for r in ordering.with_previous(df, ["k"], ["k", "v"], parts=7).collect()}
    assert by[0]["_previous"] is None and all(by[k]["_previous"]["k"] == k - 1 and by[k]["_previous"]["v"] == by[k - 1]["v"] for k in range(1, 1000))
    total = 0
    for r in sorted(ordering.running_sums(df, ["k"], {"s": F.col("v")}, parts=7).collect(), key=lambda r: r["k"]):
        total += r["v"]
        assert r["s"] == total
    assert ordering.numbered(df.limit(0), ["k"]).collect() == []


def test_ranges_hold_every_cell_of_a_box(spark):
    tiling = Tiling(0.0, 0.0, 100.0, 50.0, levels=3)
    cells = spark.range(5000).select((F.rand(1) * 100).alias("x"), (F.rand(2) * 50).alias("y")).withColumn("key", tiling.key(F.col("x"), F.col("y"))).withColumn("tile", tiling.tile(F.col("key"))).collect()
    for box in ((10, 5, 30, 20), (0, 0, 100, 50), (99, 49, 120, 80), (33.3, 20.1, 33.4, 20.2)):
        ranges = tiling.ranges(box)
        tiles = tiling.tiles_of(ranges)
        for c in cells:
            inside = box[0] <= c["x"] <= box[2] and box[1] <= c["y"] <= box[3]
            assert not inside or (any(a <= c["key"] <= b for a, b in ranges) and c["tile"] in tiles)
    assert tiling.ranges((200, 0, 300, 1)) == []
    assert len(tiling.tiles_of(tiling.ranges((10, 5, 11, 6)))) < 64 / 8


def _scanned(df):
    """Files and rows that the scans of a plan read."""
    df.collect()
    scans, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            scans.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    metric = lambda s, name: s.metrics().apply(name).value()
    return max((metric(s, "numFiles"), metric(s, "numOutputRows")) for s in scans)


def test_an_area_reads_fewer_files_and_rows(spark):
    grid = Grid2D(Axis(0.5, 1.0, 64), Axis(0.5, 1.0, 64))
    cells = grid.cells(spark).select(F.expr("timestamp_ntz'2024-01-01'").alias("time"), "y_idx", "x_idx", (F.col("cell") * 1.0).alias("value"))
    path = new_path(spark, "pruned")
    layout.write(Frame.of(cells, ("time", "y_idx", "x_idx"), geometry=grid), path, tiles=2)
    whole, part = _scanned(layout.read(spark, path).df), _scanned(layout.read(spark, path, area=(3, 3, 10, 10)).df)
    assert part[0] * 4 <= whole[0] and part[1] * 4 <= whole[1] == 64 * 64
    again = layout.read(spark, path, area=(3, 3, 10, 10))
    assert again.geometry.x.n == again.geometry.y.n == 7 and again.df.count() == 49
    plan = again.df._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_tile" in plan.split("PartitionFilters")[1]
    with pytest.raises(ValueError, match="layers"):
        layout.read(spark, path, layers=0)


def test_appends_that_are_refused(spark):
    def frame(first, n=4, grid=None, hours=1):
        rows = [(datetime(2024, 1, 1 + (first + i * hours) // 24, (first + i * hours) % 24), x, 1.0) for i in range(n) for x in range(3)]
        from gridloom.geometry.grid import Grid1D

        return Frame.of(spark.createDataFrame(rows, "time timestamp_ntz, x_idx int, value double"), ("time", "x_idx"), geometry=grid or Grid1D(Axis(0.0, 1.0, 3)))

    from gridloom.geometry.grid import Grid1D

    path = new_path(spark, "refused")
    layout.write(frame(0), path)
    with pytest.raises(ValueError, match="already"):
        layout.append(frame(3), path)
    with pytest.raises(ValueError, match="geometry"):
        layout.append(frame(4, grid=Grid1D(Axis(0.0, 2.0, 3))), path)
    with pytest.raises(ValueError, match="time step"):
        layout.append(frame(4, hours=2), path)
    layout.append(frame(4), path, batch="b")
    layout.append(frame(4), path, batch="b")
    with pytest.raises(ValueError, match="already"):
        layout.append(frame(4), path, batch="c")
    assert layout.read(spark, path, dims=("time", "x_idx")).df.count() == 24
    assert layout.open_dataset(spark, path).n_steps == 8 and layout.open_dataset(spark, path).timestep == 3600
    with pytest.raises(ValueError, match="tiled"):
        layout.read(spark, path, dims=("time", "x_idx"), area=(0, 0, 1, 1))


def test_rings_that_touch_and_mixed_orientation(spark):
    """Two squares that touch at a corner, one listed clockwise; a square hole in a third, larger one."""
    from gridloom.operators import mesh

    nodes = [(i * 10 + j, float(j), float(i), 0.0) for i in range(5) for j in range(9)]
    cell = lambda i, j: [i * 10 + j, i * 10 + j + 1, i * 10 + j + 11, i * 10 + j + 10]
    block = [cell(i, j) for i in range(1, 4) for j in range(5, 8) if (i, j) != (2, 6)]
    elements = list(enumerate([cell(0, 0), cell(1, 1)[::-1], *block]))
    rings = mesh.boundary_rings(spark.createDataFrame(nodes, "node int, x double, y double, z double"), spark.createDataFrame(elements, "element int, nodes array<int>"))
    got = sorted((r["n_nodes"], r["area"], r["is_outer"], r["parent"] is not None) for r in mesh.boundary_polygons(rings).collect())
    assert got == [(4, 1.0, False, True), (4, 1.0, True, False), (4, 1.0, True, False), (12, 9.0, True, False)]
    none = mesh.boundary_rings(spark.createDataFrame([], "node int, x double, y double, z double"), spark.createDataFrame([], "element int, nodes array<int>"))
    assert none.collect() == [] and mesh.boundary_polygons(none).collect() == []


def test_quantiles_by_ranges_equal_those_in_a_task(spark):
    from gridloom.operators import aggregate

    nan = float("nan")
    rows = [(k, float((i * 7919) % 1009), nan if k == 1 and i % 50 == 0 else float(i % 3)) for k, n in ((0, 3000), (1, 400), (2, 1)) for i in range(n)]
    rows += [(None, 5.0, nan), (None, 7.0, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    for skip in (False, True):
        for keys in (["k"], []):
            pick = lambda most: sorted((str(tuple(r)) for r in aggregate.quantile(df, keys, ["a", "b"], [0.0, 0.3, 0.5, 1.0], skip_nan=skip, most_in_task=most).collect()))  # noqa: B023, E731
            assert pick(100) == pick(None)
    plain, ranged = (aggregate.describe(df, ["a", "b"], most_in_task=most).orderBy("item").collect() for most in (None, 10))
    assert plain == ranged
    wide = aggregate.ranked(df, ["k"], ["a"], [0.5], parts=16)
    assert {r["k"]: r["_q0_0"] for r in wide.collect()}[0] == sorted(a for k, a, _ in rows if k == 0)[1499] / 2 + sorted(a for k, a, _ in rows if k == 0)[1500] / 2


def test_neighbours_equal_brute_force(spark):
    """Clusters, outliers, ties, repeated places, points far outside, and fewer elements than are asked for."""
    import numpy as np

    from gridloom.operators import interpolate

    rng = np.random.default_rng(2)
    at = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(50, 0.01, (300, 2)), rng.integers(-5, 6, (200, 2)).astype(float), [[1e4, -1e4], [0, 0], [0, 0]]])
    asked = np.concatenate([rng.normal(0, 2, (60, 2)), rng.normal(50, 1, (40, 2)), rng.uniform(-2e4, 2e4, (40, 2)), rng.integers(-5, 6, (30, 2)) + 0.5, [[0, 0], [1e4, -1e4], [1e7, 3]]])
    df = lambda a, name: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], f"{name} int, x double, y double")
    for elements, k in ((at, 1), (at, 5), (at[:3], 5), (at[:1], 2), (np.tile(at[:1], (4, 1)), 2)):
        d = np.sqrt(((asked[:, None, :] - elements[None, :, :]) ** 2).sum(axis=2))
        want = {(i, int(e), r) for i in range(len(asked)) for r, e in enumerate(np.lexsort((np.arange(len(elements)), d[i]))[:k], 1)}
        got = interpolate.nearest(df(asked, "point"), df(elements, "element"), k).collect()
        assert {(r["point"], r["element"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert interpolate.nearest(df(asked, "point"), df(at[:0], "element"), 2).collect() == []


def test_columns_and_places_are_worked_out_once(spark):
    """Both are read several times by whoever writes tiles or selects."""
    from gridloom.queries import layers as layer_queries

    f = layer_queries._values(spark, "/root/testdata/sf0.001")
    places = layout._tiled(f, 2)[2]
    assert all("/layers-" in x for x in f.geometry.layers.inputFiles())
    assert all("/places-" in x for x in places.inputFiles()) and places.count() == f.geometry.elements.count()
