"""Rules against values worked out by hand from their definitions, apart from the DuckDB twins."""

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import geo as G
from terrazzo.functions import text as T
from terrazzo.operators import classify as C
from terrazzo.operators import graph as R
from terrazzo.operators import unified as U
from terrazzo.streaming import fixes as S


def one(spark, column):
    r = spark.range(1).select(column.alias("v")).first().v
    return r.asDict() if hasattr(r, "asDict") else r


def tags(**kv):
    return F.create_map(*(F.lit(x) for k, v in kv.items() for x in (k.replace("_levels", ":levels"), v))) if kv else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(
    "t,want",
    [
        ({"highway": "footway", "foot": "no"}, "footway"),
        ({"highway": "service", "foot": "no"}, None),
        ({"highway": "service", "access": "private"}, None),
        ({"highway": "service", "access": "private", "foot": "designated"}, "road"),
        ({"highway": "service", "service": "drive-through"}, None),
        ({"highway": "cycleway", "footway": "crossing"}, "crossing"),
        ({"highway": "corridor"}, "footway"),
        ({"highway": "pedestrian", "area": "yes"}, None),
        ({"highway": "motorway"}, None),
        ({"building": "yes"}, None),
        ({}, None),
    ],
)
def test_walk_kind(spark, t, want):
    assert one(spark, T.walk_kind(tags(**t))) == want


@pytest.mark.parametrize(
    "t,height,levels,name,want",
    [
        ({"building": "university"}, None, None, "Faculty Hall", (10.5, 3, "default")),
        ({"building": "dormitory"}, None, None, "Hart College", (14, 4, "default")),
        ({"building": "yes", "building_levels": "9"}, None, None, "", (31.5, 9, "osm")),
        ({"building": "yes", "building_levels": "9"}, None, "5", "", (17.5, 5, "override")),
        ({"building": "yes"}, "12", "", "", (12, 3, "override")),
        ({"building": "roof"}, None, None, "", (4, 1, "default")),
        ({"height": "7,25 m"}, "-3", None, "", (7.3, 2, "osm")),
    ],
)
def test_building_height(spark, t, height, levels, name, want):
    got = one(spark, T.building_height(tags(**t), F.lit(height), F.lit(levels), F.lit(name)))
    assert (got["height"], got["levels"], got["source"]) == want


@pytest.mark.parametrize("site,want", [("my-site", "https://my-site.goatcounter.com/count"), ("ABC", "https://abc.goatcounter.com/count"), ("https://stats.example.org/count", "https://stats.example.org/count"), ("", ""), ("  ", ""), ("http://x.example/count", ""), ("bad site", ""), ('"><script>', ""), (None, "")])
def test_endpoint(spark, site, want):
    assert one(spark, T.endpoint_for(F.lit(site))) == want


def test_events(spark):
    ev = lambda n, x: one(spark, T.event_label(F.lit(n), F.lit(x)))
    assert ev("floor_change", "floor-2") == {"path": "floor_change", "title": "floor-2"}
    assert ev("search", None) == {"path": "search", "title": "search"}
    assert ev("page_scroll", "x") is None
    assert len(ev("search", "<b>" + "y" * 100)["title"]) == 60 and "<" not in ev("search", "<b>")["title"]


@pytest.mark.parametrize("url,want", [("https://x/a?b=1", "https://x/a?b=1"), ('https://x" onclick=', ""), ("https://a b", ""), ("ftp://x", ""), (" https://x", ""), (None, "")])
def test_safe_link(spark, url, want):
    assert one(spark, T.safe_link(F.lit(url))) == want


def test_small_rules(spark):
    got = [one(spark, T.auto_entrance_access(F.lit(c), F.lit(r))) for c, r in ((True, "corridor"), (True, "stair"), (False, "stair"), (False, "other"), (False, None))]
    assert got == ["main", "main", "emergency", "alt", "alt"]
    label = lambda n, level: one(spark, T.entrance_label(F.lit("East"), F.lit(n), F.lit(level)))
    assert (label(1, 1), label(2, 2), label(1, 0)) == ("East entrance", "East entrance 2, level 2", "East entrance")
    assert one(spark, T.room_title(F.lit("0141"), F.lit("r"), F.lit("IT"))) == "IT 141" and one(spark, T.room_title(F.lit(""), F.lit("r"), F.lit(None))) == "r"
    assert one(spark, T.plan_asset_name(F.lit("floor-x-1"))) == "FP_floor_x_1"
    assert [one(spark, T.is_searchable(F.lit(k), F.lit(t))) for k, t in (("room", "other"), ("chase", "other"), ("room", "corridor"), ("room", "mechanical"), (None, None))] == [True, False, False, False, True]
    assert one(spark, S.message(F.lit("offcampus"), F.lit(None))) == "You are not on campus yet." and one(spark, S.message(F.lit("on"), F.lit("B"))) is None
    assert one(spark, T.format_time(F.lit("noon"))) == "noon" and one(spark, T.format_time(F.lit("00:05"))) == "12:05 AM"


def test_shapes_are_in_inches(spark):
    """A corridor 6 ft wide and 60 ft long: 360 square feet, inradius 36 in, so area over its square is 40."""
    assert one(spark, G.corridor_shape(F.lit(360.0), F.lit(36.0))) == {"elong": 40.0, "narrow": True, "long": True}
    assert one(spark, G.corridor_shape(F.lit(100.0), F.lit(60.0)))["long"] is False
    t = C.room_type(F.lit("room"), F.lit(360.0), F.lit(36.0), F.lit("12"), F.lit(0), F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert one(spark, t)["why"] == "narrow and long (inradius 36 in, area/inradius^2 40)"


def test_vestibule(spark):
    rooms = spark.createDataFrame([(1, "other", "12", 90.0, 80.0, 1.0, 0), (2, "other", "13", 400.0, 90.0, 1.0, 0)], "room long, kind string, number string, area double, inradius double, convexity double, degree long")
    openings = spark.createDataFrame([(1, None, "door"), (1, 2, "door"), (2, None, "door")], "a long, b long, via string")
    ev = C.room_evidence(openings, rooms.limit(0).select(F.col("room").alias("node")))
    got = C.candidates(rooms, ev).collect()
    assert [(r.room, r.confidence, r.evidence) for r in got] == [(1, 0.35, ["vestibule: an exterior door and 1 inner passage, 90 sf"])]


def test_sole_doors(spark):
    indoor = spark.createDataFrame([(1, 1, "entrance", "main"), (2, 1, "entrance", "alt"), (3, 1, "waypoint", "emergency"), (4, 1, "entrance", "alt"), (5, 1, "entrance", "emergency")], "node long, floor long, type string, access string")
    outdoor = spark.createDataFrame([(k, "entrance", None, 1.0, 2.0) for k in (1, 2, 4, 5, 9)], "node long, type string, access string, lat double, lng double")
    edges = spark.createDataFrame([(1, 3, None), (3, 2, None), (1, 4, None)], "a long, b long, access string")
    got = {r.node: (r.joined, r.sole_door, r.outdoor) for r in U.unified_nodes(indoor, outdoor, edges).collect()}
    assert got == {1: (True, False, False), 2: (True, True, False), 3: (False, False, False), 4: (True, False, False), 5: (False, False, False), 9: (False, False, True)}


@pytest.fixture(scope="module")
def way(spark):
    """0 - 1 - 2 - 3 with a loop 0 - 4 - 2, where 2 is a junction."""
    e = spark.createDataFrame([(0, 1, 10.0), (1, 2, 10.0), (2, 3, 5.0), (0, 4, 20.0), (4, 2, 20.0)], "a long, b long, length double").withColumns({"edge": F.col("a") * 10 + F.col("b"), "access": F.lit("main"), "accessible": F.lit(True), "door": F.lit(False)})
    nodes = spark.createDataFrame([(0, 2), (1, 2), (2, 3), (3, 1), (4, 2)], "node long, degree long")
    ends = lambda k: spark.createDataFrame([(7, k, 0.0)], "query long, node long, offset double")
    return R.route_edges(e), nodes, ends


def test_reroutes(spark, way):
    e, nodes, ends = way
    p = R.find_paths(e, ends(0), ends(3))
    assert p.first().path == [0, 1, 2, 3]
    at = lambda k: p.select("query", "path", F.lit(k).alias("at"))
    r = U.reroute(e, at(0), ends(3), nodes, blocked=True).first()
    assert (r.path, r.cost) == ([0, 4, 2, 3], 45.0)
    locked = spark.createDataFrame([(7, 1)], "query long, node long")
    assert U.reroute(e, at(1), ends(3), nodes, locked=locked).first().path == [0, 4, 2, 3]
    assert U.reroute(e, at(1), ends(3), nodes).first().path == [1, 2, 3]
    both = spark.createDataFrame([(7, 1), (7, 4)], "query long, node long")
    assert U.reroute(e, at(1), ends(3), nodes, locked=both).count() == 0


def test_sentence(spark):
    paths = spark.createDataFrame([(1, [1, 2, 3, 4, 5], "IT 241")], "query long, path array<long>, destination string")
    nodes = spark.createDataFrame([(1, None, None, "x", None, None, None), (2, 1, 1, "entrance", "east door", "IT", "First Floor"), (3, 1, 1, "stair", None, "IT", "First Floor"), (4, 2, 2, "stair", None, "IT", "Second Floor"), (5, 2, 2, "room", None, "IT", "Second Floor")], "node long, floor long, level long, type string, door string, building string, floor_label string")
    lengths = spark.createDataFrame([(2, 1, 40.4), (2, 3, 5.0), (3, 4, 3.5), (5, 4, 7.0)], "a long, b long, length double")
    steps = U.route_steps(paths, nodes, lengths)
    assert [(r.kind, r.title) for r in steps.orderBy("step").collect()] == [("outdoor", "Walk to the east door of IT"), ("door", "Enter by the east door"), ("walk", "Take the stairs up to Second Floor"), ("walk", "Arrive at IT 241")]
    assert U.route_sentences(steps).first().sentence == "Walk 40 m along the path, enter by the east door, take the stairs up to Second Floor, arrive at IT 241."


def test_joins_and_copies_find_the_same_routes(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    e = spark.createDataFrame([(rnd.randrange(30), rnd.randrange(30), float(rnd.randrange(4))) for _ in range(90)], "src long, dst long, w double")
    ends = lambda: spark.createDataFrame([(q, rnd.randrange(30), float(rnd.randrange(3))) for q in range(8) for _ in range(2)], "query long, node long, offset double")
    starts, goals = ends(), ends()
    avoid = spark.createDataFrame([(q, rnd.randrange(30), rnd.randrange(30)) for q in range(8) for _ in range(60)], "query long, src long, dst long")
    for shut in (None, avoid):
        found = []
        for most in (10**6, 0):
            monkeypatch.setattr(R, "LOCAL_EDGES", most)
            found.append(sorted(map(tuple, R.find_paths(e, starts, goals, avoid=shut).collect())))
        assert found[0] and found[0] == found[1]
