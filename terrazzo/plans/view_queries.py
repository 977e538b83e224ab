"""Queries of campus views over customer, supplier, part, events and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazzo.functions import geo as G
from terrazzo.operators import editing as E
from terrazzo.operators import views as V
from terrazzo.session import fresh_path, table
from terrazzo.sources import files


def pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def box_ring(x, y, w, h):
    at = lambda a, b: G.point((x + a).cast("double"), (y + b).cast("double"))
    zero = F.lit(0)
    return F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))


def _rooms(spark, sf):
    k = F.col("s_suppkey")
    ring = box_ring(k * 37 % 900, k * 53 % 900, k % 90 + 20, k % 70 + 30)
    return table(spark, sf, "supplier").select(k.alias("room"), (k % 4).alias("floor"), pick(["corridor", "lab", "corridor", "office"], k).alias("type"), pick(["alt", "MAIN", "emergency", "odd", None], k).alias("access"), (k % 2 == 0).alias("searchable"), ring.alias("ring"))


def _nodes(spark, sf):
    k = F.col("c_custkey")
    p = G.point((k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double"))
    return table(spark, sf, "customer").select(k.alias("node"), (k % 4).alias("floor"), pick(["waypoint", "room", "entrance", "door", "waypoint", "stair"], k).alias("type"), F.when(k % 12 == 1, k % 50).alias("room"), p.alias("p"), pick(["emergency", None, "Alt", "main"], k).alias("access"))


def p03_nodes(spark, sf):
    return V.node_access(_rooms(spark, sf), _nodes(spark, sf), 100.0)


def p03_rooms(spark, sf):
    return V.room_access(_rooms(spark, sf), _nodes(spark, sf))


def p04_entrances(spark, sf):
    n = _nodes(spark, sf).select("node", "floor", "type", F.col("p.x").cast("string").alias("x"), F.when(F.col("node") % 9 == 0, "far").otherwise(F.col("p.y").cast("string")).alias("y"))
    return V.entrances(n)


def p30_markers(spark, sf):
    return V.door_markers(_nodes(spark, sf).select("node", "floor", "type", "access", "p.x", "p.y"))


def p30_photos(spark, sf):
    k = F.col("event_id")
    return V.floor_photos(table(spark, sf, "events").select(k.alias("id"), pick(["indoor", "outdoor", "indoor"], k).alias("type"), F.when(k % 5 != 0, k % 4).alias("floor"), F.when(k % 7 != 0, F.col("value")).alias("x"), F.col("value").alias("y"))).select("id", "floor", "x")


def r33_floors(spark, sf):
    k = F.col("event_id")
    steps = table(spark, sf, "events").select("user_id", pick(["walk", "turn", "stairs"], k).alias("kind"), (k % 5).alias("floor"))
    return V.walked_floors(steps, ["user_id"])


def r33_classes(spark, sf):
    return V.hallway_classes(_rooms(spark, sf))


def f37_r40_boxes(spark, sf):
    r = _rooms(spark, sf).withColumn("k", F.col("room"))
    center = V.room_center(F.when(F.col("k") % 3 == 0, (F.col("k") * 2).cast("double")), F.when(F.col("k") % 3 == 0, (F.col("k") * 5).cast("double")), F.col("ring"))
    box = V.box_of(F.col("ring"))
    focus = V.focus_box(box, F.lit(100.0), F.lit(80.0), 2.0)
    closing = F.when(F.col("k") % 2 == 0, F.concat("ring", F.array(F.get("ring", F.lit(0))))).otherwise(F.col("ring"))
    c = V.close_ring(closing, F.col("k") % 5 == 0)
    return r.select("room", center["x"].alias("cx"), center["y"].alias("cy"), box["w"].alias("w"), box["h"].alias("h"), focus["x"].alias("fx"), focus["y"].alias("fy"), focus["w"].alias("fw"), focus["h"].alias("fh"), c["method"].alias("method"), c["gap"].alias("gap"), V.ring_path(F.transform("ring", lambda p: G.point(p["x"] / 4, p["y"]))).alias("path"))


def r12_segments(spark, sf):
    r = _rooms(spark, sf)
    points = F.concat("ring", F.array(F.get("ring", F.lit(3))))
    s = V.segments(r.select("room", points.alias("points"), (F.col("room") % 2 == 0).alias("closed")), ["room"])
    return s.select("room", "pos", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def r20_r21_carried(spark, sf):
    n = _nodes(spark, sf)
    block = table(spark, sf, "customer").select((F.col("c_custkey") * 7).alias("node"), F.col("c_name").alias("label"))
    return V.carried(block, n).join(n.select("node", V.node_class(F.col("type"), F.col("access")).alias("access")), "node")


def r25_indoor(spark, sf):
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("building"), pick(["yes", "FALSE", "", None], F.col("s_suppkey")).alias("flag"))
    return V.has_indoor(b, table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("building")))


def r50_seeds(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    over = s.where("s_suppkey % 3 = 0").select(k.alias("building"), F.when(k % 2 == 0, F.concat(F.lit("New "), "s_name")).alias("name"), F.when(k % 5 != 0, F.concat(F.lit("B"), k)).alias("code"), F.lit(None).cast("string").alias("number"), (k % 4 == 0).alias("indoor"))
    levels = s.where("s_suppkey % 7 = 0").select(k.alias("building"), (k % 5 + 1).alias("levels"), F.when(k % 2 == 0, k % 30).alias("height"))
    return V.building_seeds(s.select(k.alias("building"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("place")), over, levels)


def r51_s03_nodes(spark, sf):
    n = _nodes(spark, sf).select("node", "type", "access")
    g = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 8 == 0, "alt").otherwise("").alias("access"))
    private = table(spark, sf, "supplier").select((F.col("s_suppkey") + 10**9).alias("node"), F.lit("door").alias("type"))
    return V.with_private(V.node_seeds(n, g), private)


def s02_tab(spark, sf):
    e = table(spark, sf, "events")
    cells = e.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 4 == 0, "no json").otherwise(F.col("props")).alias("props"), pick(["TRUE", "no", "", "?"], F.col("event_id")).alias("public"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.lit("x").alias(" "))
    t = V.typed_tab(cells, {"props": "k long"}, {"public": True}, ("at",))
    return t.select("id", F.col("props.k").alias("k"), "public", "at")


def r54_inputs(spark, sf):
    n = _nodes(spark, sf).select("node", "floor", "type", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "access")
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("building"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 9).alias("levels"), F.lit(None).cast("double").alias("height"))
    return V.map_inputs(n, b)


def r55_targets(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    layers = p.select(pick(["paths", "roads", "water"], k).alias("layer"), pick(["LineString", "Polygon"], k).alias("kind"), F.when(k % 5 != 0, F.concat(F.lit("way/"), k)).alias("id"), F.to_json(F.array(k, k + 1)).alias("coordinates"))
    drawn = p.select(pick(["paths", "entrances", "buildings"], k).alias("layer"), pick(["LineString", "Point"], k).alias("kind"), F.concat(F.lit("d/"), k).alias("id"), F.to_json(F.array(k)).alias("coordinates"))
    nodes = _nodes(spark, sf).select("node", "type", (F.col("node") % 180).alias("lng"), (F.col("node") % 90).alias("lat"))
    return V.snap_targets(layers, drawn, nodes)


def r55_entrances(spark, sf):
    n = _nodes(spark, sf).withColumns({"lat": F.when(F.col("node") % 11 != 0, F.col("node") % 90), "lng": F.col("node") % 180, "floor": F.col("node") % 40})
    floors = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("floor"), (F.col("n_nationkey") % 6).alias("building"))
    labels = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("label"))
    return V.editor_entrances(n, floors, labels)


def _decisions(spark, sf):
    k = F.col("s_suppkey")
    old = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(k.alias("room"), pick(["accepted", "rejected"], k / 2).alias("decision"))
    e = F.col("event_id")
    return V.decide(old, table(spark, sf, "events").select(e.alias("ord"), (e * 7 % 300).alias("room"), pick(["rejected", "", "accepted"], e).alias("decision")))


def r56_decisions(spark, sf):
    return _decisions(spark, sf)


def r56_review(spark, sf):
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").where("s_suppkey % 3 <> 1").select(k.alias("room"), F.when(k % 2 == 0, k % 4).alias("floor"), (k % 10 / 10.0).alias("confidence"))
    rooms = _rooms(spark, sf).select("room", "floor", "type", F.when(F.col("room") % 5 == 0, "").otherwise(F.concat(F.lit("R"), "room")).alias("label"), F.concat(F.lit("#"), "room").alias("number"))
    return V.review(c, _decisions(spark, sf), rooms)


def r35_t09_schedule(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("user_id", k.alias("ord"), k.alias("id"), F.date_format("ts", "HH:mm").alias("time"), (k % 3).alias("building"), (k % 2).alias("room"))
    gone = table(spark, sf, "events").where("event_id % 10 = 0").select("user_id", k.alias("id"))
    return V.schedule(e, gone, ["user_id"]).select("user_id", "place", "id", V.event_place(F.concat(F.lit("B"), "building"), F.when(F.col("room") > 0, F.col("room").cast("string"))).alias("at"))


def r36_choices(spark, sf):
    k = F.col("p_partkey")
    rooms = table(spark, sf, "part").select(k.alias("room"), (k % 60).alias("floor"), F.lpad((k * 7 % 500).cast("string"), 4, "0").alias("number"), F.when(k % 2 == 0, F.concat((k * 7 % 500).cast("string"), F.lit(" Lab"))).otherwise("").alias("label"), pick(["no", "yes", ""], k).alias("searchable"))
    floors = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("floor"), (F.col("n_nationkey") % 6).alias("building"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("B"), F.col("n_nationkey") % 6)).alias("code"))
    return V.room_choices(rooms, floors)


def g08_u08_layers(spark, sf):
    k = F.col("s_suppkey")
    s = _rooms(spark, sf)
    tags = lambda c: F.map_from_arrays(F.array(F.lit("building"), F.lit("type"), F.lit("name")), F.array(pick(["yes", "", None], c), pick(["multipolygon", "route"], c), F.when(c % 4 != 0, F.concat(F.lit("N"), c))))
    ways = s.select(F.col("room").alias("id"), tags(F.col("room")).alias("tags"), "ring", (F.col("room") % 5 != 0).alias("closed"))
    rel = table(spark, sf, "supplier").select(k.alias("id"), tags(k).alias("tags"), F.array(box_ring(k % 50, k % 40, F.lit(4), F.lit(5)), box_ring(k % 50, k % 40, k % 7 + 1, F.lit(6))).alias("rings"))
    f = V.footprints(ways, rel).select(F.col("osm_id").alias("id"), F.lit("building").alias("kind"), "name", F.col("ring").alias("points"))
    parking = s.where("room % 9 = 0").select(F.concat(F.lit("p"), "room").alias("id"), F.lit("parking").alias("kind"), F.when(F.col("room") % 2 == 0, "Lot").otherwise("").alias("name"), F.col("ring").alias("points"))
    out = V.with_labels({"footprints": f, "parking": parking}, f)
    return out.select("layer", "id", "kind", "name", F.size("points").cast("long").alias("n"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))


def a15_openings(spark, sf):
    k = F.col("l_orderkey")
    found = table(spark, sf, "lineitem").select(F.floor(k / 4).alias("floor"), (F.col("l_linenumber") % 2).alias("a"), (k * 4 + F.col("l_linenumber")).alias("ord"), (F.col("l_partkey") % 3).alias("b"), G.point((F.col("l_suppkey") % 20 * 40).cast("double"), F.lit(0)).alias("p"), (F.col("l_quantity") + 20).alias("width"))
    m = V.merged_openings(found, ["floor"])
    return m.groupBy("floor", "a", "b").agg(F.count("*").alias("n"), F.max("width").alias("width"))


def r29_plans(spark, sf):
    rooms = _rooms(spark, sf).withColumn("floor", F.col("room") % 40)
    floors = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("floor"), F.lit(800.0).alias("width"), F.when(F.col("n_nationkey") % 2 == 0, 600.0).alias("height"))
    return V.floor_svg(rooms, floors)


def r27_r31_addresses(spark, sf):
    k = F.col("page_id")
    p = table(spark, sf, "pages")
    return p.select("page_id", V.page_url(F.concat("url", F.when(k % 2 == 0, "#a?b").otherwise(""))).alias("page"), V.with_version(F.lit("data.json"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("v "), k))).alias("versioned"), V.is_id(F.when(k % 4 == 0, "a b").when(k % 4 == 1, "ok-1_B").when(k % 4 == 2, F.repeat(F.lit("x"), (k % 160).cast("int")))).alias("is_id"), V.payload_choice(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("shown"))


def _session(spark, sf):
    """Suppliers as an editing session after a creation, an update and a deletion."""
    k = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(F.concat(F.lit("s"), k).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"), k.alias("ord"))
    s = E.Session({"suppliers": E.Collection(base, "id", ["name", "nation"])})
    of = lambda m: base.where(F.col("ord") % m == 0)
    s.create("suppliers", of(7).select(F.concat(F.lit("new-"), "id").alias("id"), F.lit("made").alias("name")))
    s.update("suppliers", of(5).select("id", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("other "), "name")).alias("name")))
    s.delete("suppliers", of(11).select("id"))
    return s


def api1_api6_current(spark, sf):
    return _session(spark, sf).current("suppliers").select("id", "name", "nation")


def api_diff(spark, sf):
    return _session(spark, sf).diff("suppliers").select("id", "op")


def s01_records(spark, sf):
    """Events written as a JSON array, a record a line, and read again."""
    path = fresh_path(spark, "records")
    e = table(spark, sf, "events")
    files.write_lines(files.lines(e, "event_id", F.to_json(F.struct("event_id", "event_type", "value"))), path)
    return files.read_records(spark, path, "event_id long, event_type string, value double").select("event_id", "event_type", "value")


def s04_folder(spark, sf):
    """A JSON document a region; those whose nations number five."""
    path = fresh_path(spark, "folder")
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    n.repartitionByRange(5, "n_regionkey").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_folder(spark, path, "n_regionkey int, names array<string>", F.size("names") == 5).select("n_regionkey", F.array_join("names", ",").alias("names"))


def s06_points(spark, sf):
    """Customers as a collection of features written and read again: the points with two numbers."""
    path = fresh_path(spark, "features")
    k = F.col("c_custkey")
    at = F.when(k % 4 == 0, F.array(k.cast("double"))).otherwise(F.array(k.cast("double"), (k % 90).cast("double")))
    f = files.feature(F.when(k % 3 == 0, "LineString").otherwise("Point"), at, F.create_map(F.lit("name"), F.col("c_name")))
    head = '{"type":"FeatureCollection","features":['
    files.write_lines(files.lines(table(spark, sf, "customer"), "c_custkey", f, head, "]}"), path)
    return files.points_of(files.read_features(spark, path)).select(F.try_element_at("properties", F.lit("name")).alias("name"), "lng", "lat")


def s07_s20_catalog(spark, sf):
    found = files.read_catalog(spark, sf, {"customer": "customer.parquet", "nation": "nation.parquet", "ghost": "ghost.parquet"})
    out = None
    for name, df in found.items():
        n = F.lit(None).cast("long") if df is None else F.count("*")
        part = (spark.range(1) if df is None else df).agg(n.alias("n") if df is not None else F.max(n).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def s13_writes(spark, sf):
    """Three guarded writes of one table: new, of the same rows in another order, and of other rows."""
    path = fresh_path(spark, "guarded")
    n = table(spark, sf, "nation")
    done = [files.write_if_changed(df, path) for df in (n, n.orderBy(F.col("n_name").desc()), n.where("n_nationkey > 3"))]
    left = spark.read.parquet(path).count()
    return spark.createDataFrame([(k, d, left) for k, d in enumerate(done)], "k long, written boolean, n long")


def g07_rings(spark, sf):
    """Relations of two ways that close, in either direction, and of one that doesn't."""
    k = F.col("s_suppkey") * 10
    back = F.array(k, k + 3, k + 2)
    ways = F.array(F.array(k, k + 1, k + 2), F.when(F.col("s_suppkey") % 2 == 0, back).otherwise(F.reverse(back)), F.array(k + 7, k + 8))
    ways = F.when(F.col("s_suppkey") % 3 == 0, F.slice(ways, 1, 1)).otherwise(ways)
    out = files.outer_rings(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ways.alias("ways")))
    return out.select("id", F.to_json("rings").alias("rings"))


QUERIES = {f.__name__: f for f in (p03_nodes, p03_rooms, p04_entrances, p30_markers, p30_photos, r33_floors, r33_classes, f37_r40_boxes, r12_segments, r20_r21_carried, r25_indoor, r50_seeds, r51_s03_nodes, s02_tab, r54_inputs, r55_targets, r55_entrances, r56_decisions, r56_review, r35_t09_schedule, r36_choices, g08_u08_layers, a15_openings, r29_plans, r27_r31_addresses, api1_api6_current, api_diff, s01_records, s04_folder, s06_points, s07_s20_catalog, s13_writes, g07_rings)}

_R = """r AS (SELECT s_suppkey AS k, s_suppkey % 4 AS f, ['corridor', 'lab', 'corridor', 'office'][s_suppkey % 4 + 1] AS t, ['alt', 'main', 'emergency', 'main', 'main'][s_suppkey % 5 + 1] AS c, ['alt', 'MAIN', 'emergency', 'odd', NULL][s_suppkey % 5 + 1] AS raw,
  s_suppkey * 37 % 900 AS x0, s_suppkey * 53 % 900 AS y0, s_suppkey % 90 + 20 AS w, s_suppkey % 70 + 30 AS h FROM supplier)"""
_N = """n AS (SELECT c_custkey AS k, c_custkey % 4 AS f, ['waypoint', 'room', 'entrance', 'door', 'waypoint', 'stair'][c_custkey % 6 + 1] AS t, CASE WHEN c_custkey % 12 = 1 THEN c_custkey % 50 END AS room, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y,
  ['emergency', 'main', 'alt', 'main'][c_custkey % 4 + 1] AS c, ['emergency', NULL, 'Alt', 'main'][c_custkey % 4 + 1] AS raw FROM customer)"""
_D = """d0 AS (SELECT s_suppkey AS room, ['accepted', 'rejected'][(s_suppkey // 2) % 2 + 1] AS decision FROM supplier WHERE s_suppkey % 2 = 0),
 l AS (SELECT event_id * 7 % 300 AS room, ['rejected', '', 'accepted'][arg_max(event_id, event_id) % 3 + 1] AS decision FROM events GROUP BY 1),
 d AS (SELECT * FROM d0 WHERE room NOT IN (SELECT room FROM l) UNION ALL SELECT * FROM l WHERE decision <> '')"""
_J = "to_json(CAST(coalesce({}, '') AS VARCHAR))"
ORACLE = {
    "p03_nodes": f"""WITH {_R}, {_N}, h AS (SELECT * FROM r WHERE t = 'corridor'),
     m AS (SELECT n.*, CASE WHEN n.t = 'room' THEN h.c END AS hub FROM n LEFT JOIN h ON n.room = h.k), w AS (SELECT *, CASE WHEN hub IS NOT NULL THEN 'waypoint' ELSE t END AS nt FROM m),
     a AS (SELECT w.k, max(list_position(['main', 'alt', 'emergency'], h.c)) AS rank FROM w JOIN h ON w.f = h.f WHERE w.nt = 'waypoint' AND hub IS NULL AND pow(greatest(x0 - x, 0, x - x0 - h.w), 2) + pow(greatest(y0 - y, 0, y - y0 - h.h), 2) <= 144 GROUP BY 1)
     SELECT w.k AS node, nt AS type, CASE WHEN nt IN ('waypoint', 'door', 'entrance') THEN coalesce(hub, ['main', 'alt', 'emergency'][rank], c) END AS access FROM w LEFT JOIN a USING (k)""",
    "p03_rooms": f"WITH {_R}, {_N} SELECT k AS room, t AS type, CASE WHEN t = 'corridor' THEN c END AS access, k % 2 = 0 AND NOT (t = 'corridor' AND k IN (SELECT room FROM n WHERE t = 'room' AND room IS NOT NULL)) AS searchable FROM r",
    "p04_entrances": f"WITH {_N} SELECT k AS node, f AS floor, x::DOUBLE AS x, CASE WHEN k % 9 <> 0 THEN y::DOUBLE END AS y FROM n WHERE t = 'entrance'",
    "p30_markers": f"""WITH {_N} SELECT 'class:' || k AS id, f AS floor, x::DOUBLE AS x, y::DOUBLE AS y, CASE c WHEN 'emergency' THEN 'exit' WHEN 'alt' THEN 'door-alt' ELSE 'door-main' END AS kind,
     CASE c WHEN 'emergency' THEN 'Emergency exit (not used for directions)' WHEN 'alt' THEN 'Side door' ELSE 'Main entrance' END AS title FROM n WHERE t = 'entrance' OR (t = 'door' AND c <> 'main')""",
    "p30_photos": "SELECT event_id AS id, event_id % 4 AS floor, value AS x FROM events WHERE event_id % 3 <> 1 AND event_id % 5 <> 0 AND event_id % 7 <> 0",
    "r33_floors": "SELECT DISTINCT user_id, event_id % 5 AS floor FROM events WHERE event_id % 3 = 0",
    "r33_classes": f"WITH {_R} SELECT k AS room, c = 'emergency' AS emergency, c = 'alt' AS alt FROM r",
    "f37_r40_boxes": f"""WITH {_R} SELECT k AS room, CASE WHEN k % 3 = 0 THEN k * 2.0 ELSE x0 + w / 2.0 END AS cx, CASE WHEN k % 3 = 0 THEN k * 5.0 ELSE y0 + h / 2.0 END AS cy, w::DOUBLE AS w, h::DOUBLE AS h,
     x0 + w / 2.0 - greatest(w, 50.0) / 2 AS fx, y0 + h / 2.0 - greatest(h, 40.0) / 2 AS fy, greatest(w, 50.0) AS fw, greatest(h, 40.0) AS fh,
     CASE WHEN k % 5 = 0 THEN 'closed-flag' WHEN k % 2 = 0 THEN 'coincident-endpoints' ELSE 'implied-closing-edge' END AS method, CASE WHEN k % 2 = 0 THEN 0 ELSE h END::DOUBLE AS gap,
     'M' || a || ' ' || y0 || 'L' || b || ' ' || y0 || 'L' || b || ' ' || (y0 + h) || 'L' || a || ' ' || (y0 + h) || 'Z' AS path
     FROM (SELECT *, regexp_replace(CAST(CAST(floor(x0 * 2.5 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR), '\\.0$', '') AS a, regexp_replace(CAST(CAST(floor((x0 + w) * 2.5 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR), '\\.0$', '') AS b FROM r)""",
    "r12_segments": f"""WITH {_R}, c AS (SELECT k, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + w)::DOUBLE AS x1, (y0 + h)::DOUBLE AS y1 FROM r)
     SELECT k AS room, 0 AS pos, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS "by" FROM c UNION ALL SELECT k, 1, x1, y0, x1, y1 FROM c UNION ALL SELECT k, 2, x1, y1, x0, y1 FROM c UNION ALL SELECT k, 4, x0, y1, x0, y0 FROM c WHERE k % 2 = 0""",
    "r20_r21_carried": f"WITH {_N} SELECT k AS node, c_name AS label, coalesce(raw, 'main') AS access FROM n JOIN customer ON k = c_custkey * 7 WHERE t = 'entrance'",
    "r25_indoor": "SELECT s_suppkey AS building, s_suppkey % 4 <> 1 AND s_suppkey IN (SELECT o_custkey % 700 FROM orders) AS indoor FROM supplier",
    "r50_seeds": """SELECT s_suppkey AS building, CASE WHEN s_suppkey % 6 = 0 THEN 'New ' ELSE '' END || s_name AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN 'B' || s_suppkey ELSE '' END AS code, '' AS number, s_nationkey AS place, s_suppkey % 12 = 0 AS indoor,
     CASE WHEN s_suppkey % 7 = 0 THEN CAST(s_suppkey % 5 + 1 AS VARCHAR) ELSE '' END AS levels, CASE WHEN s_suppkey % 14 = 0 THEN CAST(s_suppkey % 30 AS VARCHAR) ELSE '' END AS height FROM supplier""",
    "r51_s03_nodes": f"WITH {_N} SELECT k AS node, t AS type, CASE WHEN t = 'entrance' AND k % 8 = 0 THEN 'alt' ELSE coalesce(raw, '') END AS access FROM n UNION ALL SELECT s_suppkey + 1000000000, 'door', NULL FROM supplier",
    "s02_tab": "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 <> 0 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS k, event_id % 4 <> 1 AS public, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM events",
    "r54_inputs": f"""WITH {_N} SELECT 'entrance' AS part, CAST(k AS VARCHAR) AS id, '["' || f || '","' || x || '.0","' || y || '.0","' || coalesce(raw, '') || '"]' AS fields FROM n WHERE t = 'entrance'
     UNION ALL SELECT 'building', CAST(s_suppkey AS VARCHAR), '["' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 9 AS VARCHAR) ELSE '' END || '",""]' FROM supplier""",
    "r55_targets": f"""WITH {_N} SELECT 'line' AS target, CASE WHEN p_partkey % 5 <> 0 THEN 'way/' || p_partkey ELSE ['paths', 'roads'][p_partkey % 3 + 1] END AS id, '[' || p_partkey || ',' || (p_partkey + 1) || ']' AS coordinates FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 2 = 0
     UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN 'line' ELSE 'entrance' END, 'd/' || p_partkey, '[' || p_partkey || ']' FROM part WHERE p_partkey % 6 IN (0, 1)
     UNION ALL SELECT 'entrance', CAST(k AS VARCHAR), '[' || (k % 180) || ',' || (k % 90) || ']' FROM n WHERE t = 'entrance'""",
    "r55_entrances": f"""WITH {_N} SELECT k AS node, CASE WHEN k % 40 < 25 THEN CAST(k % 40 % 6 AS VARCHAR) ELSE '' END AS building, k % 40 AS floor, k % 90 AS lat, k % 180 AS lng, CASE WHEN k % 3 = 0 THEN c_name ELSE CAST(k AS VARCHAR) END AS label, coalesce(raw, 'main') AS access, raw IS NOT NULL AS explicit
     FROM n JOIN customer ON k = c_custkey WHERE t = 'entrance' AND k % 11 <> 0""",
    "r56_decisions": f"WITH {_D} SELECT room, decision FROM d",
    "r56_review": f"""WITH {_R}, {_D} SELECT k AS room, k % 4 AS floor, CASE WHEN k % 5 = 0 THEN '#' || k ELSE 'R' || k END AS label, k % 10 / 10.0 AS confidence, coalesce(decision, CASE WHEN t = 'corridor' THEN 'accepted' ELSE '' END) AS decision FROM r LEFT JOIN d ON room = k WHERE k % 3 <> 1""",
    "r35_t09_schedule": """WITH e AS (SELECT user_id, event_id AS id, strftime(ts, '%H:%M') AS t, event_id % 3 AS b, event_id % 2 AS r FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, t, b, r ORDER BY id) AS n FROM e)
     SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS place, id, 'B' || b || CASE WHEN r > 0 THEN ' · ' || r ELSE '' END AS at FROM f WHERE n = 1 AND id % 10 <> 0""",
    "r36_choices": """WITH p AS (SELECT p_partkey AS k, p_partkey % 60 AS f, p_partkey * 7 % 500 AS n FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 60 < 25)
     SELECT f % 6 AS building, row_number() OVER (PARTITION BY f % 6 ORDER BY n, k) AS place, k AS room, CASE WHEN f % 2 = 0 THEN 'B' || (f % 6) || ' ' ELSE '' END || n || CASE WHEN k % 2 = 0 THEN ' – Lab' ELSE '' END AS text FROM p""",
    "g08_u08_layers": f"""WITH {_R}, f AS (SELECT 'way/' || k AS id, CASE WHEN k % 4 <> 0 THEN 'N' || k ELSE '' END AS name, x0::DOUBLE AS x, y0::DOUBLE AS y, x0 + w / 2.0 AS cx, y0 + h / 2.0 AS cy FROM r WHERE k % 3 = 0 AND k % 5 <> 0
       UNION ALL SELECT 'relation/' || k, CASE WHEN k % 4 <> 0 THEN 'N' || k ELSE '' END, k % 50, k % 40, k % 50 + CASE WHEN (k % 7 + 1) * 6 > 20 THEN (k % 7 + 1) / 2.0 ELSE 2 END, k % 40 + CASE WHEN (k % 7 + 1) * 6 > 20 THEN 3.0 ELSE 2.5 END FROM r WHERE k % 6 = 0),
     p AS (SELECT 'p' || k AS id, CASE WHEN k % 2 = 0 THEN 'Lot' ELSE '' END AS name, x0::DOUBLE AS x, y0::DOUBLE AS y, x0 + w / 2.0 AS cx, y0 + h / 2.0 AS cy FROM r WHERE k % 9 = 0)
     SELECT 'footprints' AS layer, id, 'building' AS kind, name, 4::BIGINT AS n, x, y FROM f UNION ALL SELECT 'parking', id, 'parking', name, 4, x, y FROM p
     UNION ALL SELECT 'labels', id, 'building', name, 1, cx, cy FROM f WHERE name <> '' UNION ALL SELECT 'labels', id, 'parking', name, 1, cx, cy FROM p WHERE name <> ''""",
    # midpoints are 40 apart or equal and widths 70 at most, so equal midpoints merge and others don't
    "a15_openings": """SELECT l_orderkey // 4 AS floor, l_linenumber % 2 AS a, l_partkey % 3 AS b, count(DISTINCT l_suppkey % 20) AS n, max(l_quantity + 20)::DOUBLE AS width FROM lineitem GROUP BY 1, 2, 3""",
    "r29_plans": f"""WITH {_R}, p AS (SELECT k % 40 AS floor, k, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM r),
     g AS (SELECT floor, string_agg('<path data-room-id="' || k || '" d="M' || x0 || ' ' || y0 || ' L' || x1 || ' ' || y0 || ' L' || x1 || ' ' || y1 || ' L' || x0 || ' ' || y1 || ' Z"/>', '' ORDER BY k) AS s, max(x1) + min(x0) AS w, max(y1) + min(y0) AS h FROM p GROUP BY 1)
     SELECT floor, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || CASE WHEN floor < 25 THEN 800 ELSE w END || ' ' || CASE WHEN floor < 25 AND floor % 2 = 0 THEN 600 ELSE h END || '"><g id="rooms">' || s || '</g></svg>' AS svg FROM g""",
    "r27_r31_addresses": """SELECT page_id, regexp_extract(url, '^([^#?]*)', 1) AS page, 'data.json' || CASE WHEN page_id % 3 = 1 THEN '?v=v+' || page_id ELSE '' END AS versioned, CASE page_id % 4 WHEN 1 THEN true WHEN 2 THEN page_id % 160 BETWEEN 1 AND 80 ELSE false END AS is_id,
     CASE WHEN page_id % 6 = 0 THEN 'new' WHEN page_id % 5 = 0 THEN 'stale' WHEN page_id % 2 = 0 THEN 'other' ELSE 'none' END AS shown FROM pages""",
    "api1_api6_current": """SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'other ' || s_name WHEN s_suppkey % 5 <> 0 THEN s_name END AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_suppkey % 11 <> 0
      UNION ALL SELECT 'new-s' || s_suppkey, 'made', '' FROM supplier WHERE s_suppkey % 7 = 0""",
    "api_diff": """SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN 'delete' ELSE 'edit' END AS op FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 5 = 0 UNION ALL SELECT 'new-s' || s_suppkey, 'new' FROM supplier WHERE s_suppkey % 7 = 0""",
    "s01_records": "SELECT event_id, event_type, value FROM events",
    "s04_folder": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1 HAVING count(*) = 5",
    "s06_points": "SELECT c_name AS name, c_custkey::DOUBLE AS lng, (c_custkey % 90)::DOUBLE AS lat FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0",
    "s07_s20_catalog": "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'ghost', NULL",
    "s13_writes": "SELECT k, k <> 1 AS written, (SELECT count(*) FROM nation WHERE n_nationkey > 3) AS n FROM range(3) t(k)",
    "g07_rings": """SELECT k AS id, CASE WHEN k % 3 = 0 THEN '[]' ELSE '[[' || k * 10 || ',' || k * 10 + 1 || ',' || k * 10 + 2 || ',' || k * 10 + 3 || ',' || k * 10 || ']]' END AS rings FROM (SELECT s_suppkey AS k FROM supplier)""",
}
