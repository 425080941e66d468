"""Round trips, text formats, parameter documents and streams."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from gridloom import Frame, Item
from gridloom.geometry.mesh import Mesh
from gridloom.sources import layout, params, text

T0 = datetime(2000, 1, 1)


def frame(spark):
    rows = [(T0 + timedelta(days=20 * t), x, float(t * 10 + x), float("nan") if x else 1.0) for t in range(5) for x in range(3)]
    return Frame.of(spark.createDataFrame(rows, "time timestamp_ntz, x_idx int, T double, S double"), ("time", "x_idx"), [Item("T", "Temperature"), Item("S", "Salinity")])


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_layout_round_trip_and_pruning(spark, tmp_path):
    f, path = frame(spark), str(tmp_path / "f")
    layout.write(f, path)
    back = layout.read(spark, path, dims=("time", "x_idx"))
    assert rows(back.df) == rows(f.df) and {i.name: i.quantity for i in back.items} == {"T": "Temperature", "S": "Salinity"}
    part = layout.read(spark, path, dims=("time", "x_idx"), items="T", start="2000-01-20", stop="2000-02")
    assert rows(part.df) == rows(f["T"].sel(time=slice("2000-01-20", "2000-02")).df)
    plan = part.df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_period" in plan and "S:double" not in plan.rpartition("ReadSchema")[2].splitlines()[0]
    later = Frame.of(f.df.selectExpr("time + INTERVAL 1 YEAR AS time", "x_idx", "T", "S"), ("time", "x_idx"))
    layout.append(later, path)
    assert layout.read(spark, path, dims=("time", "x_idx")).n_steps() == 10
    assert layout.to_long(f["T"]).count() == 15 and '"Temperature"' in layout.header(f)


def test_mesh_text_round_trip(spark, tmp_path):
    mesh = Mesh(np.array([[0, 0, -1], [1, 0, -2], [1, 1, -3.5], [0, 1, 0], [2, 0.5, 0]], dtype=float), [[0, 1, 2, 3], [1, 4, 2]], np.array([1, 1, 0, 2, 3]), "LONG/LAT")
    text.write_mesh(spark, mesh, str(tmp_path / "m"))
    back = text.read_mesh(spark, str(tmp_path / "m"))
    assert back == mesh and back.elements == mesh.elements and back.codes.tolist() == [1, 1, 0, 2, 3] and back.boundary_codes == [1, 2, 3]
    short = text.parse_mesh(["3  UTM-33", "1 0 0 0 1", "2 1 0 0 1", "3 0 1 0 1", "1 3 21", "1 1 2 3"])
    assert short.projection == "UTM-33" and short.elements == [[0, 1, 2]]


def test_xyz_and_csv(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("1.5 2 -3 here it is\n4\t5\t6\n\n")
    assert [tuple(r) for r in text.read_xyz(spark, str(tmp_path / "p.xyz")).orderBy("x").collect()] == [(1.5, 2, -3, "here it is"), (4, 5, 6, None)]
    (tmp_path / "s.csv").write_text("Date, Level\n2000-01-01, 1.5\n2000-01-02, -99.99\n2000-01-03,\n")
    got = text.read_series_csv(spark, str(tmp_path / "s.csv"), "Date", ["Level"], missing=[-99.99]).orderBy("time").collect()
    assert got[0]["Level"] == 1.5 and np.isnan([got[1]["Level"], got[2]["Level"]]).all() and got[0]["time"] == T0


DOCUMENT = """
[Engine]  // comment
  file = |a,b.nc|
  names = 'u//v,w', "two", 3, -1.5e3, true
  empty =
  [POINT_1]
    x = 1
  EndSect
  [POINT_2]
    x = 2
  EndSect  // POINT_2
  x = 9
  x = 10
EndSect
[Engine]
  z = false
EndSect
"""


def test_documents(spark):
    table = params.parse_documents(spark.createDataFrame([("d", DOCUMENT), ("e", None)], "doc string, text string"))
    assert table.count() == 8
    assert params.to_dict(DOCUMENT) == {"Engine": [{"file": "a,b.nc", "names": ["u//v,w", "two", 3, -1500.0, True], "empty": [], "POINT_1": {"x": 1}, "POINT_2": {"x": 2}, "x": [9, 10]}, {"z": False}]}
    assert [tuple(r) for r in params.numbered_sections(table, "POINT", ["x"]).orderBy("number").collect()] == [("d", "Engine", 1, "1"), ("d", "Engine", 2, "2")]
    assert params.search(table, key="NAM").count() == 1 and params.search(table, key="NAM", case=True).count() == 0
    assert params.search(table, param=2).count() == 1 and params.search(table, section="point").count() == 2 and params.search(table, param=False).count() == 1
    assert params.search(table, "nc").count() == 1
    assert params.at_path(table, "Engine/POINT_1/x").select(params.value("int")).first()[0] == 1
    changed = params.find_replace(table, 2, 5)
    assert params.search(changed, param=5).count() == 1 and params.search(changed, param=2).count() == 0
    again = params.to_text(table).first()["text"]
    assert params.to_dict(again) == params.to_dict(DOCUMENT)
    assert not params.is_unique(table).where("doc = 'd'").first()["is_unique"]
    assert params.first_of_repeated(table).where("key = 'x' and size(path) = 1").count() == 1
    assert params.merge(table, changed).count() == 8
    with pytest.raises(params.DocumentError):
        list(params.parse("[A]\n x = 1\n"))


def test_stream_equals_batch(spark, tmp_path):
    from gridloom.streaming.windows import windowed

    df = frame(spark).df
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, ["x_idx"], ["T"], size="30 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("w")) == rows(windowed(df, ["x_idx"], ["T"], size="30 days"))


def test_mesh_tables_round_trip_and_damage(spark, tmp_path):
    mesh = Mesh(np.array([[0, 0, -1], [1, 0, -2], [1, 1, -3.5], [0, 1, 0], [2, 0.5, 0]], dtype=float), [[0, 1, 2, 3], [1, 4, 2]], np.array([1, 1, 0, 2, 3]), "UTM-33")
    text.write_mesh_tables(mesh.as_tables(spark), str(tmp_path / "m"))
    back = text.read_mesh_tables(spark, str(tmp_path / "m"))
    assert sorted((r["element"], r["nodes"]) for r in back.elements.collect()) == [(0, [0, 1, 2, 3]), (1, [1, 4, 2])]
    assert sorted(tuple(r) for r in back.nodes.collect()) == [(i, *map(float, mesh.nodes[i]), int(mesh.codes[i])) for i in range(5)]
    assert back.projection == "UTM-33" and back.boundary_codes() == [1, 2, 3] and not back.is_geo
    back.check()
    assert text.read_mesh(spark, str(tmp_path / "m")) == mesh
    (tmp_path / "short.mesh").write_text("\n".join(text.format_mesh(mesh).splitlines()[:-1]))
    with pytest.raises(ValueError, match="last element"):
        text.read_mesh_tables(spark, str(tmp_path / "short.mesh"))
    (tmp_path / "bad.mesh").write_text("1 LONG/LAT\n1 0 0 0 0\n1 3 21\n1 1 2 3\n")
    with pytest.raises(ValueError, match="element 0"):
        text.read_mesh_tables(spark, str(tmp_path / "bad.mesh")).check()


def test_scope_deletes_what_was_stored(spark):
    from gridloom.sources.shared import path_of, scope, stored

    with scope(spark) as made:
        gone, kept = stored(spark.range(3), "gone"), stored(spark.range(4), "kept")
        paths = path_of(gone), path_of(kept)
        made.pop()
    assert kept.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(paths[0]).count()


def test_documents_from_rows_with_gaps(spark):
    rows = spark.createDataFrame([("d", "A/B", 2, "x", None), ("d", "A/B", 1, None, None), ("e", "A", 1, "it", 2.5)], "doc string, parent string, number int, name string, size double")
    table = params.from_rows(rows, "P", ["name", "size"])
    texts = {r["doc"]: r["text"] for r in params.to_text(table).collect()}
    assert texts["d"].split() == "[A] [B] [P_1] EndSect // P_1 [P_2] name = 'x' EndSect // P_2 EndSect // B EndSect // A".split()
    again = params.parse_documents(params.to_text(table))
    assert {(r["doc"], r["value"]) for r in params.get(again, "A/B/P_2/name", "none").collect()} == {("d", "x"), ("e", "none")}
    assert {(r["name"], r["is_section"], r["n"]) for r in params.children(again, "A").where("doc = 'd'").collect()} == {("B", True, 1)}
    assert params.cleared(again, "A/B").where("doc = 'd'").select("key").collect()[0]["key"] is None
    assert params.from_rows(rows.limit(0), "P", ["name"]).collect() == []
