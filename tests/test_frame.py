"""Frames on literal data with known results."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Frame, Item
from gridloom.geometry import BoundingBox, Grid1D, Grid2D, Mesh, OutsideDomainError
from gridloom.geometry.grid import Axis
from gridloom.items import InvalidValueType, ItemsError, safe_name, search_quantities, short_unit, unique_names, value_type
from gridloom.plans import pipeline

NAN = float("nan")
DAY = timedelta(days=1)
T0 = datetime(2000, 1, 1)


def series(spark, step=DAY, start=T0, **items):
    names = list(items)
    rows = [(start + i * step, *map(float, v)) for i, v in enumerate(zip(*items.values(), strict=True))]
    return Frame.of(spark.createDataFrame(rows, "time timestamp_ntz, " + ", ".join(f"`{n}` double" for n in names)))


def values(frame, *names):
    rows = frame.df.orderBy(*frame.dims).collect() if frame.dims else frame.df.collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def same(a, b):
    return len(a) == len(b) and all((math.isnan(x) and math.isnan(y)) or math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b, strict=True))


def test_nan_block(spark):
    f = series(spark, a=[1, 2, 3], b=[NAN, NAN, NAN])
    for how, a in (("nanmean", 2), ("nanmax", 3), ("nanmin", 1), ("nanstd", math.sqrt(2 / 3))):
        assert same(values(f.aggregate(how), "a", "b")[0], (a, NAN))


def test_nan_propagates(spark):
    f = series(spark, a=[1, NAN, 3], b=[2, 4, 6])
    for how, b in (("mean", 4), ("max", 6), ("min", 2), ("std", math.sqrt(8 / 3)), ("ptp", 4)):
        assert same(values(f.aggregate(how), "a", "b")[0], (NAN, b))
    assert same(values(f.quantile(0.5), "a", "b")[0], (NAN, 4))
    assert same(values(f.nanquantile(0.5), "a", "b")[0], (2, 4))


def test_single_row_has_no_spread(spark):
    assert values(series(spark, a=[5], b=[10]).std(), "a", "b") == [(0.0, 0.0)]


def test_quantile_list_names_its_items(spark):
    f = series(spark, Foo=[0.1] * 10, Bar=[0.2] * 10).quantile([0.25, 0.75])
    assert f.names == ["Quantile 0.25, Foo", "Quantile 0.25, Bar", "Quantile 0.75, Foo", "Quantile 0.75, Bar"]
    assert values(f, *f.names) == [(0.1, 0.2, 0.1, 0.2)]


def test_over_items(spark):
    f = series(spark, Foo=[1.5, NAN], Bar=[2, 4], Baz=[3, 6])
    assert same(values(f.mean("items"), "mean"), [6.5 / 3, NAN])
    assert same(values(f.nanmean("items"), "nanmean"), [6.5 / 3, 5])
    assert same(values(f.min("items"), "min"), [1.5, NAN])
    assert same(values(f.aggregate("nanmin", "items"), "nanmin"), [1.5, 4])
    assert same(values(f.aggregate("nanstd", "items"), "nanstd")[1:], [1.0])
    assert same(values(f.quantile(0.5, "items"), "Quantile 0.5"), [2, NAN])
    assert same(values(f.quantile(0.5, "items", skip_nan=True), "Quantile 0.5"), [2, 5])


def test_dropna_keeps_steps_that_all_items_have(spark):
    f = series(spark, a=[1] * 9 + [NAN], b=[1] * 8 + [NAN] * 2).dropna()
    assert f.n_steps() == 8


def test_fillna_leaves_its_input_alone(spark):
    f = series(spark, foo=[NAN, 1], bar=[2, NAN])
    assert values(f.fillna(), "foo", "bar") == [(0, 2), (1, 0)]
    assert same(values(f, "foo"), [NAN, 1])


def test_interp_na(spark):
    f = series(spark, Foo=[NAN, 1, NAN, NAN, 4], Bar=[NAN, NAN, NAN, 4, 4])
    assert same(values(f.interp_na(), "Foo"), [NAN, 1, 2, 3, 4])
    g = f.interp_na(extrapolate=True)
    assert same(values(g, "Foo"), [0, 1, 2, 3, 4]) and same(values(g, "Bar"), [4, 4, 4, 4, 4])


def test_interp_time(spark):
    f = series(spark, v=[0, 2, 0, 4])
    assert f.interp_time(3600).n_steps() == 73
    assert values(f.interp_time("12h"), "v") == [0, 1, 2, 1, 0, 2, 4]
    assert f.interp_time("2h").timestep() == 7200
    other = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in (-1, 6, 72, 73)], "time timestamp_ntz")
    assert values(f.interp_time(other, fill_value=-9), "v") == [-9, 0.5, 4, -9]
    assert values(f.interp_time(other, fill_value=-9, method="nearest"), "v") == [-9, 0, 4, -9]
    with pytest.raises(ValueError):
        f.interp_time(other, extrapolate=False)
    with pytest.raises(ValueError):
        f.interp_time("6h", method="cubic")


def test_brackets_are_carried_over_chunks_of_time(spark):
    from gridloom.operators import interpolate

    f = series(spark, v=[0, 100], step=timedelta(days=100))
    target = spark.createDataFrame([(T0 + timedelta(days=d),) for d in (25, 50, 75)], "time timestamp_ntz")
    df = interpolate.interp_time(f.df, target, [], ["v"], chunk_seconds=86_400)
    assert [r["v"] for r in df.orderBy("time").collect()] == [25, 50, 75]


def test_concat(spark):
    a, b = series(spark, v=[1, 2, 3]), series(spark, start=T0 + 2 * DAY, v=[30, 40])
    assert values(Frame.concat([a, b]), "v") == [1, 2, 30, 40]
    assert values(Frame.concat([a, b], keep="first"), "v") == [1, 2, 3, 40]
    twice = Frame.of(a.df.unionByName(a.df))
    with pytest.raises(ValueError, match="duplicate timestamps"):
        Frame.concat([twice, b])
    with pytest.raises(ValueError):
        Frame.concat([a, b], keep="middle")


def test_concat_average(spark):
    parts = [series(spark, start=T0 + 3 * i * DAY, v=[i] * 5) for i in range(3)]
    df = pipeline.concat([p.df for p in parts], ["time"], keep="average", max_gap=86_400)
    assert [r["v"] for r in df.orderBy("time").collect()] == [0, 0, 0, 0.5, 0.5, 1, 1.5, 1.5, 2, 2, 2]
    late = series(spark, start=T0 + 30 * DAY, v=[1])
    with pytest.raises(ValueError, match="gap"):
        pipeline.concat([parts[0].df, late.df], ["time"], max_gap=86_400)


def test_time_selection(spark):
    f = series(spark, v=[0, 1, 2, 3])
    assert values(f.isel(time=-1), "v") == [3]
    assert values(f.isel(time=slice(1, 4)), "v") == [1, 2, 3]
    assert values(f.isel(time=[0, -2]), "v") == [0, 2]
    assert values(f.sel(time="2000-01-02"), "v") == [1]
    assert values(f.sel(time=slice("2000-01-02", "2000-01-04")), "v") == [1, 2, 3]
    assert values(f.sel(time="2000-01"), "v") == [0, 1, 2, 3]
    assert values(f.sel(time=slice(None, datetime(2000, 1, 2))), "v") == [0, 1]


def test_item_selection(spark):
    f = series(spark, Foo=[1.5], Bar=[2], Baz=[3])
    assert f[["Baz", "Foo"]].names == ["Baz", "Foo"] and f["Ba*"].names == ["Bar", "Baz"] and f[-1].names == ["Baz"]
    assert f.rename({"Foo": "New"}).names == ["New", "Bar", "Baz"] and f.drop("Bar").names == ["Foo", "Baz"]
    for wrong in ("Nope", 7, "X*"):
        with pytest.raises(ItemsError):
            f[wrong]


def test_arithmetic(spark):
    f = series(spark, a=[-7, 7, 0, NAN, 5], b=[3, -3, 0, 1, 0])
    a, b = f["a"], f["b"]
    assert same(values(a % b, "a"), [2, -2, NAN, NAN, NAN])
    assert same(values(a // b, "a"), [-3, -3, NAN, NAN, math.inf])
    assert same(values(a / b, "a"), [-7 / 3, -7 / 3, NAN, NAN, math.inf])
    assert values(a < b, "a") == [True, False, False, False, False]
    assert values(a >= 0, "a") == [False, True, True, False, True]
    assert values(a.equals(a), "a") == [True, True, True, False, True]
    assert values(a.differs(a), "a") == [False, False, False, True, False]
    assert same(values(10 - a, "a"), [17, 3, 10, NAN, 5]) and same(values(abs(-a), "a"), [7, 7, 0, NAN, 5])
    assert same(values(f + 1 - f, "a"), [1, 1, 1, NAN, 1])
    with pytest.raises(ValueError):
        f + Frame.of(f.df.withColumn("c", F.lit(1.0)))


def test_merge(spark):
    a, b = series(spark, v=[1, 2]), series(spark, w=[3, 4])
    assert values(Frame.merge([a, b]), "v", "w") == [(1, 3), (2, 4)]
    with pytest.raises(ValueError):
        Frame.merge([a, a])
    with pytest.raises(ValueError):
        Frame.merge([a, series(spark, w=[3, 4, 5])])


def test_pipeline_windows(spark):
    f = series(spark, v=range(10))
    got = lambda **o: [r["v"] for r in pipeline.extract(f.df, **o).orderBy("time").collect()]
    assert got(start=2, stop=-3, step=2) == [2, 4, 6]
    assert got(start=86_400.0, stop=3 * 86_400.0) == [1, 2, 3]
    assert got(start="2000-01-03, 2000-01-05") == [2, 3, 4]
    with pytest.raises(KeyError, match="there are: v"):
        pipeline.transform(f.df, ["v"], [pipeline.Derived("x", lambda c: c["w"])], keys=["time"])


def test_mean_time_of_valid_steps(spark):
    f = series(spark, a=[1, NAN, 3], b=[1, 2, 3])
    assert same(pipeline.mean_time(f.df, [], ["a", "b"]).first(), (2, 2))
    cells = f.df.withColumn("cell", F.lit(0))
    assert same(pipeline.mean_time(cells, ["cell"], ["a", "b"], require_all_valid=True).select("a", "b").first(), (NAN, 2))


def test_custom_aggregate(spark):
    f = Frame.of(spark.createDataFrame([(T0 + i * DAY, i % 2, float(i)) for i in range(6)], "time timestamp_ntz, x_idx int, v double"), ("time", "x_idx"))
    assert values(f.apply(lambda s: s.prod()), "v") == [0, 15]


def test_chaining_and_geometry(spark):
    grid = Grid2D(Axis(0, 1, 3), Axis(0, 1, 2))
    rows = [(T0 + t * DAY, y, x, float(t * 6 + y * 3 + x)) for t in range(4) for y in range(2) for x in range(3)]
    f = Frame.of(spark.createDataFrame(rows, "time timestamp_ntz, y_idx int, x_idx int, v double"), ("time", "y_idx", "x_idx"), geometry=grid)
    assert values(f.isel(time=1).mean("space"), "v") == values(f.mean("space").isel(time=1), "v") == [8.5]
    assert values(f.sel(x=2.2, y=0.9).max(), "v") == [23] and f.sel(x=2.2).geometry.dims == ("y",)
    assert f.mean("x_idx").dims == ("time", "y_idx") and isinstance(f.mean("y_idx").geometry, Grid1D)
    assert values(f.sel(area=(0.5, -1, 3, 0.5)).mean(None), "v") == [10.5]
    assert f.isel(x_idx=0).dims == ("time", "y_idx")
    with pytest.raises(OutsideDomainError):
        f.sel(x=99.0)
    with pytest.raises(ValueError):
        f.mean("z")


def test_grids():
    assert Grid2D.in_box([0, 0, 1, 5], nx=2, ny=5).x.x0 == 0.25
    assert Grid2D.in_box([0, 0, 1, 5]).shape == (50, 10)
    assert Grid2D.in_box([0, 0, 1, 5], dx=0.5).y.dx == 0.5
    assert math.prod(Grid2D.in_box([0, 0, 1, 5], dx=0.5, dy=2.5).shape) == 4
    g = Grid2D.in_box([0, 0, 1, 5], dx=0.2)
    assert g.find_index(x=0.52, y=1.52) == {"x": 2, "y": 7}
    with pytest.raises(OutsideDomainError):
        g.find_index(x=1.5, y=0.5)
    mesh = Grid2D(Axis(0, 1, 5), Axis(0, 2, 3)).to_mesh()
    assert len(mesh.elements) == 15 and len(mesh.nodes) == 24
    assert [int(mesh.codes[i]) for i in (0, 1, -2, -1)] == [2, 3, 5, 4]
    with pytest.raises(ValueError):
        Axis.parse([0, 1, 3])
    with pytest.raises(ValueError):
        BoundingBox(1, 0, 0, 1)
    assert BoundingBox.parse([0, 0, 2, 2]).overlaps(BoundingBox(1, 1, 3, 3)) and not BoundingBox(0, 0, 1, 1).overlaps(BoundingBox(2, 2, 3, 3))


MESH = Mesh(__import__("numpy").array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0.5, 1.5, 0]], dtype=float), [[0, 1, 2], [0, 2, 3], [3, 2, 4]], __import__("numpy").array([1, 1, 1, 1, 1]))


def test_mesh_lookup(spark):
    from gridloom.operators import mesh

    nodes, elements = MESH.node_table(spark), MESH.element_table(spark)
    points = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.1, 0.5), (2, -0.5, -0.1), (3, 0.5, 1.4)], "point int, x double, y double")
    assert sorted(map(tuple, mesh.find_elements(points, nodes, elements).collect())) == [(0, 0), (1, 1), (2, None), (3, 2)]
    assert {tuple(r) for r in mesh.boundary_faces(elements).select("a", "b").collect()} == {(0, 1), (1, 2), (2, 4), (3, 4), (0, 3)}
    rings = mesh.boundary_rings(nodes, elements)
    assert [r["node"] for r in sorted(rings.collect(), key=lambda r: r["place"])] == [0, 1, 2, 4, 3]
    assert [(r["n_nodes"], r["area"], r["is_outer"], r["parent"]) for r in mesh.boundary_polygons(rings).collect()] == [(5, 1.25, True, None)]
    areas = {r["element"]: r["area"] for r in mesh.element_area(nodes, elements).collect()}
    assert areas == {0: 0.5, 1: 0.5, 2: 0.25}
    w = mesh.regrid_weights(points, nodes, elements, k=2)
    sums = {r[0]: r[1] for r in w.groupBy("point").agg(F.sum("weight")).collect()}
    assert math.isnan(sums[2]) and all(math.isclose(sums[k], 1) for k in (0, 1, 3))
    assert mesh.to_wkt(nodes, elements).where("element = 0").first()["wkt"] == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))"
    assert len(MESH.subset([2]).nodes) == 3 and MESH == Mesh(MESH.nodes.copy(), MESH.elements)
    with pytest.raises(ValueError):
        Mesh(MESH.nodes, [[0, 1, 9]])
    few_nodes, few = mesh.renumber(nodes, elements.where("element = 2"))
    assert sorted(r["node"] for r in few_nodes.collect()) == [0, 1, 2] and few.first()["nodes"] == [1, 0, 2]


def test_idw_weights(spark):
    from gridloom.operators import interpolate

    near = spark.createDataFrame([(0, 5, 1.0, 1), (0, 6, 2.0, 2), (1, 7, 0.0, 1), (1, 8, 3.0, 2)], "point int, element int, distance double, rank int")
    got = {(r["point"], r["element"]): r["weight"] for r in interpolate.idw_weights(near, p=1).collect()}
    assert math.isclose(got[0, 5], 2 / 3) and math.isclose(got[0, 6], 1 / 3) and got[1, 7] == 1 and got[1, 8] == 0


def test_layers(spark):
    from gridloom.operators import layered

    elements = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5]), (1, [3, 4, 5, 6, 7, 8]), (2, [9, 10, 11, 12, 13, 14])], "element int, nodes array<int>")
    layers = layered.columns_of(elements)
    assert sorted(map(tuple, layers.collect())) == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]
    assert sorted(r["element"] for r in layered.at_layer(elements.select("element"), layers, "top").collect()) == [1, 2]
    assert [r["element"] for r in layered.at_layer(elements.select("element"), layers, -2).collect()] == [0]
    assert sorted(map(tuple, layered.to_2d(elements, layers).collect())) == [(0, [0, 1, 2]), (1, [9, 10, 11])]
    z = spark.createDataFrame([(0, -10.0, 1.0), (0, -5.0, 2.0), (0, 0.0, 4.0), (1, -1.0, 7.0)], "column int, z double, v double")
    got = {(r["column"], r["z"]): r["v"] for r in layered.interp_z(z, ["column"], "z", "v", [-12.5, -7.5, -2.5]).collect()}
    assert got == {(0, -12.5): 0.5, (0, -7.5): 1.5, (0, -2.5): 3.0, (1, -12.5): 7.0, (1, -7.5): 7.0, (1, -2.5): 7.0}


def test_metadata():
    assert Item("T", "Temperature").unit == "degree_Celsius" and short_unit("meter_pow_3_per_sec") == "m^3/s"
    assert "Water_Level" in search_quantities("level") and unique_names(["a", "b", "a"]) == ["a", "b", "a_2"] and safe_name("1 a-b") == "_1_a_b"
    assert value_type(2) == value_type("stepaccumulated") == "StepAccumulated"
    for wrong in (lambda: Item("T", "Temperature", "meter"), lambda: Item("T", "Nothing")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(InvalidValueType):
        value_type("x")


def small_grid(spark):
    rows = spark.range(12).selectExpr("timestamp_ntz'2000-01-01' as time", "cast(id div 6 as int) as y_idx", "cast(id % 6 as int) as x_idx", "cast(id as double) as v")
    return Frame.of(rows, ("time", "y_idx", "x_idx"), geometry=Grid2D(Axis(10.0, 2.0, 6), Axis(0.0, 1.0, 2)))


def test_cells_by_number(spark):
    f = small_grid(spark)
    got = lambda x: sorted((r.y_idx, r.x_idx, r.v) for r in x.df.collect())
    assert sorted(r.v for r in f.isel(x_idx=-1).df.collect()) == [5, 11]
    assert got(f.isel(x_idx=[-1])) == [(0, 0, 5), (1, 0, 11)]
    assert got(f.isel(x_idx=slice(None, -4), y_idx=[1])) == [(0, 0, 6), (0, 1, 7)]
    step = f.isel(x_idx=slice(0, 6, 2))
    assert got(step) == [(0, 0, 0), (0, 1, 2), (0, 2, 4), (1, 0, 6), (1, 1, 8), (1, 2, 10)]
    assert step.geometry.x == Axis(10.0, 4.0, 3)
    assert got(f.isel(x_idx=slice(None, None, -1), y_idx=[0]))[0] == (0, 0, 5)
    assert got(f.isel(x_idx=[0, 5, 1], y_idx=[0])) == [(0, 0, 0), (0, 1, 5), (0, 2, 1)]
    with pytest.raises(IndexError):
        f.isel(x_idx=6)
    assert f.isel(x_idx=slice(4, 4)).df.count() == 0


def test_cells_by_label_cut_the_grid(spark):
    f = small_grid(spark).sel(area=(12, 0.5, 17, 2))
    assert sorted((r.y_idx, r.x_idx, r.v) for r in f.df.collect()) == [(0, 0, 7), (0, 1, 8), (0, 2, 9)]
    assert f.geometry.x == Axis(12.0, 2.0, 3)
    with pytest.raises(ValueError):
        small_grid(spark).sel(area=(0, 0, 1, 1), x=1.0)


def test_selection_on_a_mesh(spark):
    nodes = np.array([[x, y, 0.0] for y in range(3) for x in range(4)])
    mesh = Mesh(nodes, [[i + 4 * j, i + 1 + 4 * j, i + 5 + 4 * j, i + 4 + 4 * j] for j in range(2) for i in range(3)])
    rows = spark.range(6).selectExpr("timestamp_ntz'2000-01-01' as time", "cast(id as int) as element", "cast(id as double) as v")
    f = Frame.of(rows, ("time", "element"), geometry=mesh)
    some = f.sel(area=(1, 0, 3, 1))
    assert sorted(r.element for r in some.df.collect()) == [1, 2] and some.geometry.elements.count() == 2 and some.geometry.nodes.count() == 6
    assert sorted(r.element for r in f.sel(area=[(0, 0), (3, 0), (0, 2)]).df.collect()) == [0, 1, 3]
    point = f.sel(x=2.5, y=1.5)
    assert [r.v for r in point.df.collect()] == [5] and point.dims == ("time",)
    assert [r.v for r in f.isel(element=-1).df.collect()] == [5]
    assert sorted(r.element for r in f.isel(element=slice(1, None, 2)).df.collect()) == [1, 3, 5]
    with pytest.raises(OutsideDomainError):
        f.sel(x=9.0, y=9.0)


def test_arrays_there_and_back(spark):
    a = np.arange(12.0).reshape(2, 3, 2)
    a[1, 2, 0] = np.nan
    f = Frame.from_numpy(spark, {"a": a, "b": 2 * a}, ("time", "y_idx", "x_idx"), times=["2024-01-01", "2024-01-02"])
    assert f.names == ["a", "b"] and f.n_steps() == 2
    back = f.to_numpy()
    np.testing.assert_array_equal(back["a"], a)
    np.testing.assert_array_equal(f.flipud().to_numpy()["b"], 2 * a[:, ::-1])
    assert f.isel(time=[0], x_idx=[1]).squeeze().dims == ("y_idx",)
    with pytest.raises(ValueError):
        Frame.from_numpy(spark, {"a": a, "b": a[0]}, ("time", "y_idx", "x_idx"))


def test_insert_puts_an_item_in_its_place(spark):
    f = Frame.of(spark.sql("SELECT timestamp_ntz'2024-01-01' AS time, 1.0 AS a, 2.0 AS b"))
    assert f.insert(1, "c", F.col("a") + F.col("b")).names == ["a", "c", "b"]
    with pytest.raises(ValueError):
        f.insert(0, "b", F.col("a"))


def test_append_refuses_other_items(spark, tmp_path):
    from gridloom.sources import layout

    path = str(tmp_path / "data")
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01' AS time, 1.0 AS a")
    layout.write(Frame.of(rows, items=[Item("a", "Surface_Elevation", "meter")]), path)
    with pytest.raises(ItemsError):
        layout.append(Frame.of(rows.withColumnRenamed("a", "b")), path)
    with pytest.raises(ValueError):
        layout.append(Frame.of(rows, items=[Item("a", "Surface_Elevation", "feet")]), path)
    with pytest.raises(ValueError, match="already"):
        layout.append(Frame.of(rows, items=[Item("a", "Surface_Elevation", "meter")]), path)
    later = spark.sql("SELECT timestamp_ntz'2024-01-02' AS time, 1.0 AS a")
    layout.append(Frame.of(later, items=[Item("a", "Surface_Elevation", "meter")]), path)
    assert layout.read(spark, path).df.count() == 2
