import json

import pytest
from pyspark.sql import functions as F

from terrazzo.operators import merge as M
from terrazzo.operators import quality as Q
from terrazzo.operators.editing import Collection, Refused, Session
from terrazzo.sources import files


@pytest.fixture
def session(spark):
    floors = spark.createDataFrame([("f1", "1", 0), ("f2", "2", 1)], "id string, level string, ord long")
    rooms = spark.createDataFrame([("r1", "f1", "main", 0), ("r2", "f2", "", 1)], "id string, floor string, access string, ord long")
    rules = lambda: [Q.one_of("access", F.col("access"), ("main", "alt", "emergency")), Q.required("floor", F.col("floor"))]
    return Session({"floors": Collection(floors, "id", ["level"]), "rooms": Collection(rooms, "id", ["floor", "access"], rules, [Q.Reference("floor", floors, "id", "floors")])})


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord").collect()]


def test_create_update_delete(spark, session):
    session.create("rooms", spark.createDataFrame([("r3", "f1", "alt")], "id string, floor string, access string"))
    session.update("rooms", spark.createDataFrame([("r1", None)], "id string, access string"))
    session.delete("rooms", spark.createDataFrame([("r2",)], "id string"))
    assert rows(session.current("rooms"), "id", "floor", "access") == [("r1", "f1", None), ("r3", "f1", "alt")]
    assert session.version == 3
    assert {(r.id, r.op) for r in session.diff("rooms").collect()} == {("r1", "edit"), ("r2", "delete"), ("r3", "new")}
    report = {r.collection: r for r in session.report().collect()}
    assert (report["rooms"].edited, report["rooms"].added, report["rooms"].deleted) == (1, 1, 1)


def test_refused_edits_leave_nothing(spark, session):
    cases = [
        lambda: session.create("rooms", spark.createDataFrame([("r1", "f1")], "id string, floor string")),
        lambda: session.update("rooms", spark.createDataFrame([("r9", "f1")], "id string, floor string")),
        lambda: session.update("rooms", spark.createDataFrame([("r1", "odd")], "id string, access string")),
        lambda: session.update("rooms", spark.createDataFrame([("r1", "f9")], "id string, floor string")),
        lambda: session.update("rooms", spark.createDataFrame([("r1", "x")], "id string, color string")),
    ]
    for case in cases:
        with pytest.raises(Refused):
            case()
    assert session.version == 0 and session.diff("rooms").isEmpty()


def test_gate_sees_the_proposed_state(spark, session):
    session.gate = lambda tables: tables["floors"].where("level = '9'").select("id")
    session.update("floors", spark.createDataFrame([("f1", "3")], "id string, level string"))
    with pytest.raises(Refused):
        session.update("floors", spark.createDataFrame([("f1", "9")], "id string, level string"))
    assert rows(session.current("floors"), "level") == [("3",), ("2",)]


def test_save_writes_changes_only(spark, session, tmp_path):
    assert session.save(str(tmp_path)) == {"floors": True, "rooms": True}
    assert session.save(str(tmp_path)) == {"floors": False, "rooms": False}
    session.update("rooms", spark.createDataFrame([("r1", "alt")], "id string, access string"))
    assert session.save(str(tmp_path)) == {"floors": False, "rooms": True}
    assert json.loads(spark.read.parquet(f"{tmp_path}/rooms").first().fields) == {"access": "alt"}


def test_merge_edge_cases(spark):
    base = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "id string, v string, ord long")
    m = "id string, ord long, op string, fields map<string,string>"
    changes = [("b", 1, "delete", {}), ("b", 2, "new", {}), ("a", 3, "delete", {}), ("a", 4, "edit", {"v": "x"}), ("z", 5, "delete", {}), ("n", 6, "new", {"v": "9"}), ("n", 7, "edit", {"v": "8"})]
    c = spark.createDataFrame(changes, m)
    assert rows(M.apply_overrides(base, c, "id", ["v"]), "id", "v") == [("b", ""), ("n", "8")]
    r = M.merge_report(base, c, "id", ["v"]).first()
    assert (r.orphans, r.duplicates, r.added) == (2, 3, 2)
    none = spark.createDataFrame([], m)
    assert M.apply_overrides(base, none, "id", ["v"]).count() == 2
    assert M.apply_overrides(base.limit(0), none, "id", ["v"]).count() == 0


def test_read_records(spark, tmp_path):
    assert files.read_records(spark, f"{tmp_path}/no.json", "id string, v int").columns == ["id", "v", "ord"]
    (tmp_path / "yes.json").write_text('[\n {"id": "b", "v": 2},\n {"id": "a"}\n]')
    assert rows(files.read_records(spark, f"{tmp_path}/yes.json", "id string, v int"), "id", "v") == [("b", 2), ("a", None)]
    (tmp_path / "bad.json").write_text('[{"id": "b"')
    with pytest.raises(Exception, match="bad.json|MALFORMED"):
        files.read_records(spark, f"{tmp_path}/bad.json", "id string, v int").collect()


def test_features_round_trip(spark, tmp_path):
    one = {"type": "Feature", "properties": {"name": "door"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}
    odd = {"type": "Feature", "id": "x", "properties": {}, "geometry": {"type": "Point", "coordinates": ["no"]}}
    way = {"type": "Feature", "id": "w", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [one, odd, way]}))
    f = files.read_features(spark, f"{tmp_path}/f.json")
    assert [(r.id, r.kind) for r in f.orderBy("ord").collect()] == [("override/0", "Point"), ("x", "Point"), ("w", "LineString")]
    assert [(r.lng, r.lat, r.properties["name"]) for r in files.points_of(f).collect()] == [(1.5, 2.0, "door")]


def test_lines_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "k long")
    assert [r.line for r in files.lines(none, "k", F.to_json(F.struct("k"))).collect()] == ["[]"]
    some = spark.createDataFrame([(5,), (3,)], "k long")
    files.write_lines(files.lines(some, "k", F.to_json(F.struct("k"))), f"{tmp_path}/out")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect())) == [{"k": 3}, {"k": 5}]


def test_outer_rings(spark):
    ways = [[1, 2, 3], [5, 4, 3], [5, 1], [9, 10], [7, 8, 11, 7], []]
    df = spark.createDataFrame([(1, ways), (2, [])], "id long, ways array<array<long>>")
    got = {r.id: [list(x) for x in r.rings] for r in files.outer_rings(df).collect()}
    assert got == {1: [[1, 2, 3, 4, 5, 1], [7, 8, 11, 7]], 2: []}


def test_folder_and_catalog(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"building": "b1",\n "t": 1}')
    (tmp_path / "in" / "b.json").write_text('{"t": 2}')
    got = files.read_folder(spark, f"{tmp_path}/in", "building string, t int", F.col("building").isNotNull())
    assert [(r.building, r.file) for r in got.collect()] == [("b1", "a.json")]
    spark.range(2).write.parquet(f"{tmp_path}/t.parquet")
    c = files.read_catalog(spark, str(tmp_path), {"t": "t.parquet", "no": "no.parquet"})
    assert c["t"].count() == 2 and c["no"] is None
