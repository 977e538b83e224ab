"""Queries of quality rules, lookups and classification over customer, orders, part, supplier and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazzo.functions import geo as G
from terrazzo.functions import text as T
from terrazzo.operators import aggregate as A
from terrazzo.operators import classify as C
from terrazzo.operators import lookup as L
from terrazzo.operators import quality as Q
from terrazzo.plans.geo_queries import points, rings
from terrazzo.session import table


def pick(xs, by):
    return F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))


def _records(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    return o.select(
        k,
        pick(["main", "alt", "odd", ""], k).alias("access"),
        F.when(k % 11 == 0, "x1").otherwise((k % 50).cast("string")).alias("level"),
        F.when(k % 13 == 0, "[[0,0],[1,1]]").when(k % 17 == 0, "no").otherwise("[[0,0],[1,0],[1,1]]").alias("polygon"),
        F.col("o_custkey").alias("a"),
        F.when(k % 19 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + F.when(k % 23 == 0, 10**7).otherwise(1) % 5).alias("b"),
        F.when(k % 29 == 0, "").otherwise("t").alias("title"),
    )


RULES = lambda: [
    Q.one_of("access", F.col("access"), ("main", "alt", "emergency")),
    Q.number_in("level", F.col("level"), 0, 40),
    Q.polygon(F.col("polygon")),
    Q.differ(F.col("a"), F.col("b"), "an edge must join two different nodes"),
    Q.required("title", F.col("title")),
]


def p20_first_problem(spark, sf):
    ref = Q.Reference("b", table(spark, sf, "customer"), "c_custkey", "customer")
    return Q.first_problem(_records(spark, sf), "o_orderkey", RULES(), [ref])


def p26_all_problems(spark, sf):
    ref = Q.Reference("b", table(spark, sf, "customer"), "c_custkey", "customer")
    return Q.all_problems(_records(spark, sf), "o_orderkey", RULES(), [ref])


_REC = """WITH r AS (SELECT o_orderkey AS k, ['main', 'alt', 'odd', ''][o_orderkey % 4 + 1] AS access, CASE WHEN o_orderkey % 11 = 0 THEN 'x1' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS level,
  o_custkey AS a, CASE WHEN o_orderkey % 19 = 0 THEN o_custkey WHEN o_orderkey % 23 = 0 THEN o_custkey + 0 ELSE o_custkey + 1 END AS b FROM orders),
f AS (SELECT *, CASE WHEN access = 'odd' THEN 'access must be main, alt or emergency (got odd)' END AS p1,
  CASE WHEN level = 'x1' THEN 'level must be a number (got x1)' WHEN k % 50 > 40 THEN 'level must be from 0 to 40 (got ' || level || ')' END AS p2,
  CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN 'polygon must be three or more pairs of numbers' END AS p3,
  CASE WHEN a = b THEN 'an edge must join two different nodes' END AS p4, CASE WHEN k % 29 = 0 THEN 'title is required' END AS p5,
  CASE WHEN b NOT IN (SELECT c_custkey FROM customer) THEN 'b names no customer: ' || b END AS p6 FROM r)"""


def p22_duplicates(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("user_id") % 40 == 0, "").otherwise(F.concat(F.col("event_type"), F.col("user_id").cast("string"))).alias("id"))
    return Q.duplicates(e, "id")


def p19_changes(spark, sf):
    from terrazzo.plans.merge_queries import changes

    c = changes(spark, sf).withColumn("op", F.when(F.col("ord") % 7 == 0, "odd").otherwise(F.col("op"))).withColumn("c_custkey", F.when(F.col("ord") % 9 == 0, "").otherwise(F.col("c_custkey").cast("string")))
    return Q.change_problems(c, "c_custkey")


def p25_rings(spark, sf):
    k = F.col("p_partkey")
    ring = F.when(k % 5 == 0, F.array(*(G.point(F.lit(i), F.lit(i)) for i in (0, 1, 2, 0)))).when(k % 5 == 1, F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (1, 0), (1, 1))))).when(k % 5 == 2, F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))).otherwise(F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 0)))))
    p = table(spark, sf, "part").select("p_partkey", Q.ring_problem(ring, G.area(ring)).alias("ring"), Q.position_problem((k % 400).cast("double"), F.when(k % 7 != 0, (k % 100).cast("double"))).alias("position"))
    return p


def p29_leaks(spark, sf):
    patterns = spark.createDataFrame([("red .*",), ("(hot|cold) ring",)], "pattern string")
    return Q.leaks(table(spark, sf, "part"), "p_partkey", "p_name", patterns)


def p31_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", Q.root_relative(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("n"), F.get("l", F.lit(0)).alias("first"))


def j20_rooms(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    rooms = p.select(F.concat(F.lit("rm"), k).alias("room"), F.col("p_size").alias("building"), F.lpad((k % 200).cast("string"), 4, "0").alias("number"), (k % 3).alias("level"), k.alias("ord"))
    buildings = p.select(F.col("p_size").alias("building"), F.concat(F.lit("B-"), "p_size").alias("code")).distinct()
    asked = p.where("p_partkey % 2 = 0").select(k.alias("query"), F.col("p_size").alias("building"), F.when(k % 4 == 0, F.concat(F.lit(" b"), "p_size", F.lit("-"), (k % 200).cast("string"))).otherwise(F.concat(F.lit("rm"), k)).alias("text"))
    return L.find_rooms(asked, rooms, buildings)


def j21_cascade(spark, sf):
    c = table(spark, sf, "customer")
    key = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NATION_"), "c_nationkey")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("R"), F.col("c_nationkey") % 7)).otherwise("none")
    asked = c.select("c_custkey", key.alias("k"))
    n = table(spark, sf, "nation").select("n_name", F.concat(F.lit("n"), "n_nationkey").alias("v"))
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("rk"), F.concat(F.lit("r"), "r_regionkey").alias("v"))
    return L.cascade(asked, "k", "c_custkey", [(n, "n_name", "v"), (r, "rk", "v")])


def j22_target(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    t = c.select(F.col("c_nationkey").alias("b"), (k % 4).alias("priority"), k.alias("ord"), F.when(k % 3 != 0, k.cast("double")).alias("lat"), k.cast("double").alias("lng"), F.col("c_name").alias("name"))
    return L.best_target(t, "b").select("b", "name", "priority")


def j05_hubs(spark, sf):
    k = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select(k.alias("node"), (k % 500).alias("room"), pick(["room", "door", "stair"], k).alias("type"))
    rooms = table(spark, sf, "part").select(F.col("p_partkey").alias("room"), pick(["corridor", "lab"], F.col("p_partkey")).alias("kind"))
    return L.hubs_to_corridors(nodes, rooms).select("node", "type")


def j23_decorate(spark, sf):
    return L.decorate(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation").where("n_nationkey < 20"), "n_nationkey", "n_name", F.concat(F.lit("nation "), "c_nationkey"), "label").select("c_custkey", "label")


def j06_entrances(spark, sf):
    k = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select(k.alias("node"), F.when(k % 5 == 0, "entrance").otherwise("room").alias("type"), (k % 30).alias("floor"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"), pick(["alt", "MAIN", "emergency"], k).alias("access"))
    edges = nodes.select(F.col("node").alias("ord"), F.col("node").alias("a"), (F.col("node") + 30).alias("b")).unionByName(nodes.select((F.col("node") + 10**6).alias("ord"), F.col("node").alias("a"), (F.col("node") + 1).alias("b")))
    floors = spark.range(30).select(F.col("id").alias("floor"), F.floor(F.col("id") / 3).alias("building"), (F.col("id") % 3 + 1).alias("level"))
    t = F.struct(F.lit(36.6).alias("origin_lat"), F.lit(-88.3).alias("origin_lng"), F.lit(0.0).alias("degrees"), F.lit(1.0).alias("unit"), F.lit(False).alias("reflected"))
    georef = spark.range(8).select(F.col("id").alias("building"), t.alias("t"), G.point(F.lit(0), F.lit(0)).alias("off"))
    facing = nodes.where("node % 35 = 0").select("node", F.lit(91.0).alias("bearing"))
    return L.entrances(nodes, edges, floors, georef, facing).select("node", "building", "access", "label")


def j13_tags(spark, sf):
    k = F.col("n_nationkey")
    spaces = rings(spark, sf).select(k.cast("long").alias("space"), "ring", F.when(k % 3 == 0, F.concat(F.lit("N"), (k + F.when(k % 2 == 0, 1).otherwise(500)).cast("string"))).alias("own"))
    tags = points(spark, sf).select(F.col("c_custkey").alias("tag"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("number"), "p")
    return L.match_tags(spaces, tags)


def j14_stack(spark, sf):
    from terrazzo.operators import spatial as S

    k = F.col("n_nationkey")
    x = (k % 5 * 150).cast("double")
    y = (k * 7 % 40).cast("double")
    at = lambda dx, dy: G.point(x + dx, y + dy)
    r = table(spark, sf, "nation").select(k.alias("id"), F.floor(k / 5).alias("level"), F.array(at(0, 0), at(200, 0), at(200, 100), at(0, 100)).alias("ring"))
    return S.best_overlap(r, "id", "level", 100.0).select("id", "other")


def j15_runs(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.minute(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") > 15).alias("open"))
    a = L.adjacency(e, ["user_id"], 60, 3)
    return a.select("user_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))


def j16_nearest(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    gaps = c.where("c_custkey % 2 = 0").select(k.alias("gap"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"))
    swings = c.where("c_custkey % 3 = 1").select(k.alias("swing"), (k * 53 % 1000).cast("double").alias("sx"), (k * 29 % 1000).cast("double").alias("sy"))
    return L.nearest_within(gaps, swings, 30.0)


def j17_infer(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    rooms = p.select(k.alias("room"), pick(["corridor", "lab", "office"], k).alias("kind"))
    openings = p.where("p_partkey % 4 <> 0 and p_partkey % 5 <> 0").select(k.alias("a"), k.alias("b"))
    near = p.select(k.alias("a"), (k + 1).alias("b"), (k % 9 + 1).alias("length")).unionByName(p.select(k.alias("a"), (k + 3).alias("b"), (k % 5 + 1).alias("length")))
    return L.infer_missing(rooms, openings, near.join(rooms.select(F.col("room").alias("b")), "b", "left_semi").select("a", "b", "length"))


def j25_probe(spark, sf):
    doors = points(spark, sf).select(F.col("c_custkey").alias("door"), "p", F.lit(1.0).alias("dx"), F.lit(0.5).alias("dy"))
    r = L.probe(doors, rings(spark, sf).select(F.col("n_nationkey").alias("ring_id"), "ring"), 100.0, 6, 10.0)
    return r.select("door", F.col("ring_id").cast("long").alias("ring_id"), F.col("k").cast("long").alias("k"))


def _rooms(spark, sf):
    k = F.col("p_partkey")
    number = F.when(k % 10 == 0, F.concat((k % 30).cast("string"), F.lit("00"))).when(k % 10 == 1, "UNK-1").otherwise("12")
    return table(spark, sf, "part").select(k.alias("room"), F.when(k % 5 == 0, "corridor").when(k % 7 == 0, "lab").otherwise("other").alias("kind"), number.alias("number"), (k * 7 % 200 + 20).cast("double").alias("area"), (k * 3 % 120 + 2).cast("double").alias("inradius"))


def _openings(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    via = F.when(k % 4 == 0, "open").when(k % 4 == 1, "inferred").otherwise("door")
    e = p.select(k.alias("a"), (k * 3 % 100).alias("b"), via.alias("via")).unionByName(p.select(k.alias("a"), (k * 7 % 100).alias("b"), via.alias("via"))).unionByName(p.where("p_partkey % 3 = 0").select(k.alias("a"), ((k + 1) % 100).alias("b"), F.lit("open").alias("via")))
    out = p.where("p_partkey % 11 = 0").select(k.alias("a"), F.lit(None).cast("long").alias("b"), via.alias("via"))
    return e.where("a <> b").unionByName(out)


def x01_refine(spark, sf):
    return C.refine(_rooms(spark, sf), _openings(spark, sf)).select("room", "kind", "why")


def _x01() -> str:
    rules = """CASE WHEN regexp_full_match(number, '\\d?\\d00[A-Z]?') AND area >= 80 AND n >= 3 AND h >= 1 THEN 'circulation number ' || number || ' with passages to ' || n || ' spaces, ' || h || ' of them hallways'
      WHEN d = 0 AND x = 0 AND h >= 2 AND area >= 40 THEN 'open link between ' || h || ' hallways (area lines or openings, no door)'
      WHEN n >= 7 AND inradius <= 96 AND h >= 1 THEN 'hall serving ' || n || ' spaces, ' || CAST(floor(2 * inradius / 12 + 0.5) AS BIGINT) || ' ft wide at most'
      WHEN inradius <= 60 AND area * 144 / (inradius * inradius) >= 8 AND h >= 2 AND n >= 3 THEN 'narrow passage (inradius ' || CAST(inradius AS BIGINT) || ' in) joining ' || h || ' hallways and ' || (n - h) || ' other spaces' END"""
    via = "['open', 'inferred', 'door', 'door'][room % 4 + 1]"
    sql = f"""WITH r0 AS (SELECT p_partkey AS room, CASE WHEN p_partkey % 5 = 0 THEN 'corridor' WHEN p_partkey % 7 = 0 THEN 'lab' ELSE 'other' END AS kind, CASE WHEN p_partkey % 10 = 0 THEN (p_partkey % 30) || '00' WHEN p_partkey % 10 = 1 THEN 'UNK-1' ELSE '12' END AS number,
      CAST(p_partkey * 7 % 200 + 20 AS DOUBLE) AS area, CAST(p_partkey * 3 % 120 + 2 AS DOUBLE) AS inradius, CAST(NULL AS VARCHAR) AS why FROM part),
      o AS (SELECT room AS a, room * 3 % 100 AS b, {via} AS via FROM r0 UNION ALL SELECT room, room * 7 % 100, {via} FROM r0 UNION ALL SELECT room, (room + 1) % 100, 'open' FROM r0 WHERE room % 3 = 0),
      s AS (SELECT a, b, via FROM o WHERE a <> b UNION ALL SELECT b, a, via FROM o WHERE a <> b UNION ALL SELECT room, NULL, {via} FROM r0 WHERE room % 11 = 0)"""
    for i in range(3):
        sql += f""", e{i} AS (SELECT a AS room, count(DISTINCT b) AS n, count(DISTINCT b) FILTER (b IN (SELECT room FROM r{i} WHERE kind = 'corridor')) AS h, count(*) FILTER (via <> 'open') AS d, count(*) FILTER (via = 'open') AS p, count(*) FILTER (b IS NULL) AS x FROM s GROUP BY 1),
      f{i} AS (SELECT r.*, CASE WHEN kind = 'other' THEN {rules} END AS f FROM r{i} r LEFT JOIN (SELECT r{i}.room AS q, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(d, 0) AS d, coalesce(x, 0) AS x FROM r{i} LEFT JOIN e{i} USING (room)) x ON r.room = q),
      r{i + 1} AS (SELECT room, CASE WHEN f IS NOT NULL THEN 'corridor' ELSE kind END AS kind, number, area, inradius, coalesce(why, f) AS why FROM f{i})"""
    return sql


def x08_candidates(spark, sf):
    rooms, openings = _rooms(spark, sf), _openings(spark, sf)
    ev = C.room_evidence(openings, rooms.where("kind = 'corridor'").select(F.col("room").alias("node")))
    r = rooms.withColumns({"convexity": (F.col("room") % 10) / 10.0, "degree": F.col("room") % 5})
    return C.candidates(r, ev).select("room", "confidence", F.array_join("evidence", "; ").alias("evidence"))


_CAND = f"""{_x01()}, c AS (SELECT r.room, number, area, inradius, regexp_full_match(number, '\\d?\\d00[A-Z]?') AS c1, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(x, 0) > 0 AND area <= 300 AND n BETWEEN 1 AND 2 AS c2, area * 144 / (inradius * inradius) AS el,
    inradius <= 72 AND area * 144 / (inradius * inradius) >= 8 AS c3, (r.room % 10) / 10.0 AS cx, coalesce(p, 0) > 0 AND coalesce(h, 0) > 0 AS c5, r.room % 5 AS g, starts_with(number, 'UNK-') AS c7
  FROM r0 r LEFT JOIN e0 USING (room) WHERE kind = 'other'),
g AS (SELECT room, CASE WHEN c1 THEN 0.3 ELSE 0 END + CASE WHEN c2 THEN 0.35 ELSE 0 END + CASE WHEN n >= 4 THEN least(0.35, 0.2 + 0.03 * (n - 4)) ELSE 0 END + CASE WHEN c3 THEN 0.2 ELSE 0 END + CASE WHEN cx < 0.75 THEN 0.1 ELSE 0 END + CASE WHEN c5 THEN 0.15 ELSE 0 END + CASE WHEN g >= 3 THEN 0.15 ELSE 0 END + CASE WHEN c7 THEN 0.1 ELSE 0 END AS t,
  concat_ws('; ', CASE WHEN c1 THEN 'circulation-style number ' || number END, CASE WHEN c2 THEN 'vestibule: an exterior door and ' || n || CASE WHEN n = 1 THEN ' inner passage, ' ELSE ' inner passages, ' END || CAST(area AS BIGINT) || ' sf' END, CASE WHEN n >= 4 THEN 'passages to ' || n || ' spaces' END,
    CASE WHEN c3 THEN 'narrow and long (inradius ' || CAST(inradius AS BIGINT) || ' in, area/inradius^2 ' || CAST(floor(el + 0.5) AS BIGINT) || ')' END, CASE WHEN cx < 0.75 THEN 'L or T shaped (convexity ' || printf('%.2f', cx) || ')' END, CASE WHEN c5 THEN 'open to ' || h || CASE WHEN h = 1 THEN ' hallway' ELSE ' hallways' END || ' (area line or opening, no door)' END,
    CASE WHEN g >= 3 THEN 'routes pass through it (' || g || ' passages meet at its center)' END, CASE WHEN c7 THEN 'no room number in the drawing' END) AS evidence FROM c)
SELECT room, CAST(least(1, t) AS DOUBLE) AS confidence, evidence FROM g WHERE t >= 0.35"""


def x02_types(spark, sf):
    k = F.col("p_partkey")
    area, inradius, number = (k % 600).cast("double"), (k % 120 + 1).cast("double"), F.concat((k % 20).cast("string"), F.lit("00"))
    t = C.room_type(F.when(k % 9 == 0, "chase").otherwise("room"), area, inradius, number, F.when(k % 13 == 0, k % 3).otherwise(0), k % 5, F.when(k % 17 == 0, "stair"), F.lit("treads"))
    return table(spark, sf, "part").select("p_partkey", t["type"].alias("type"), t["why"].alias("why"))


def m24_scores(spark, sf):
    k = F.col("p_partkey")
    s = C.entrance_score(pick(["corridor", "other", "lab", "stair", "closet"], k), (k % 80).cast("double"), (k % 50).cast("double"), k % 2 == 0, (k % 360).cast("double"), F.when(k % 3 != 0, (k * 7 % 360).cast("double")))
    return table(spark, sf, "part").select("p_partkey", G.half_up(s, 4).alias("score"))


def m23_outward(spark, sf):
    r = rings(spark, sf)
    door = F.get("ring", F.lit(0))
    mid = G.point((door["x"] + F.get("ring", F.lit(1))["x"]) / 2, (door["y"] + F.get("ring", F.lit(1))["y"]) / 2)
    o = C.outward(mid, F.col("ring"), G.centroid(F.col("ring")))
    return r.select("n_nationkey", G.half_up(o["x"], 4).alias("x"), G.half_up(o["y"], 4).alias("y"))


def x05_x06_segments(spark, sf):
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select("c_nationkey", k.alias("seg"), (k * 7 % 50).cast("double").alias("y"), (k * 13 % 200).cast("double").alias("x0"), (k * 13 % 200 + 10 + k % 30).cast("double").alias("x1"))
    m = C.collinear(s, ["c_nationkey"], 2.0).groupBy("c_nationkey").agg(F.count("*").alias("n_merged"), F.sum(F.col("x1") - F.col("x0")).alias("total"))
    p = C.facing_forms(s, ["c_nationkey"], 3.0, 6.0, 8.0).groupBy("c_nationkey").agg(F.sum(F.col("n_lo") * F.col("n_hi")).alias("n_pairs"))
    return m.join(p, "c_nationkey", "left")


def x03_procrustes(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    ax, ay = (k * 37 % 100).cast("double"), (k * 91 % 100).cast("double")
    r = F.radians(n * 10)
    pairs = table(spark, sf, "customer").select("c_nationkey", ax.alias("ax"), ay.alias("ay"), (2 * (ax * F.cos(r) - ay * F.sin(r)) + n).alias("bx"), (2 * (ax * F.sin(r) + ay * F.cos(r)) - 5).alias("by_"))
    p = C.procrustes(pairs, ["c_nationkey"])
    return p.select("c_nationkey", *(G.half_up(F.pmod(F.col(c), F.lit(360.0)) if c == "degrees" else F.col(c), 3).alias(c) for c in ("degrees", "scale", "dx", "dy")))


QUERIES = {f.__name__: f for f in (p20_first_problem, p26_all_problems, p22_duplicates, p19_changes, p25_rings, p29_leaks, p31_links, j20_rooms, j21_cascade, j22_target, j05_hubs, j23_decorate, j06_entrances, j13_tags, j14_stack, j15_runs, j16_nearest, j17_infer, j25_probe, x01_refine, x08_candidates, x02_types, m24_scores, m23_outward, x05_x06_segments, x03_procrustes)}
ORACLE = {
    "p20_first_problem": f"{_REC} SELECT k AS o_orderkey, coalesce(p1, p2, p3, p4, p5, p6) AS problem FROM f WHERE coalesce(p1, p2, p3, p4, p5, p6) IS NOT NULL",
    "p26_all_problems": f"{_REC} SELECT * FROM (SELECT k AS o_orderkey, unnest([p1, p2, p3, p4, p5, p6]) AS problem FROM f) WHERE problem IS NOT NULL",
    "p22_duplicates": "SELECT id, CASE WHEN id = '' THEN 'id is blank' ELSE 'id occurs ' || n || ' times' END AS problem FROM (SELECT CASE WHEN user_id % 40 = 0 THEN '' ELSE event_type || user_id END AS id, count(*) AS n FROM events GROUP BY 1) WHERE id = '' OR n > 1",
    "p19_changes": """WITH c AS (SELECT c_custkey * 10 AS o FROM customer WHERE c_custkey % 17 = 0 UNION ALL SELECT c_custkey * 10 + 1 FROM customer WHERE c_custkey % 51 = 0 UNION ALL SELECT c_custkey * 10 + 2 FROM customer WHERE c_custkey % 23 = 0
      UNION ALL SELECT c_custkey * 10 + 3 FROM customer WHERE c_custkey % 46 = 0 UNION ALL SELECT c_custkey * 10 + 4 FROM customer WHERE c_custkey % 29 = 0 UNION ALL SELECT c_custkey * 10 + 5 FROM customer WHERE c_custkey % 31 = 0)
      SELECT o AS ord, CASE WHEN o % 9 = 0 THEN 'a change needs a key' ELSE 'op must be edit, new or delete' END AS problem FROM c WHERE o % 9 = 0 OR o % 7 = 0""",
    "p25_rings": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a ring needs an area' WHEN 1 THEN 'a ring needs four positions' WHEN 2 THEN 'a ring must end where it begins' END AS ring,
      CASE WHEN p_partkey % 7 = 0 THEN 'a position needs two numbers' WHEN p_partkey % 400 > 180 OR p_partkey % 100 > 90 THEN 'a position must be on the earth' END AS position FROM part""",
    "p29_leaks": "SELECT p_partkey, 'red .*' AS pattern FROM part WHERE p_name LIKE '%red %' UNION ALL SELECT p_partkey, '(hot|cold) ring' FROM part WHERE p_name LIKE '%hot ring%' OR p_name LIKE '%cold ring%'",
    "p31_links": f"""SELECT page_id, CAST(len(l) AS BIGINT) AS n, l[1] AS first FROM (SELECT page_id, regexp_extract_all(html, '{Q.ROOT_RELATIVE.replace("'", "''")}') AS l FROM pages)""",
    "j20_rooms": """WITH r AS (SELECT p_partkey AS k, p_size AS b, p_partkey % 200 AS n, p_partkey % 3 AS level FROM part), q AS (SELECT * FROM r WHERE k % 2 = 0),
      h AS (SELECT q.k AS query, r.k, r.level FROM q JOIN r USING (b) WHERE (q.k % 4 = 0 AND r.n = q.n) OR (q.k % 4 <> 0 AND r.k = q.k))
      SELECT query, 'rm' || arg_min(k, level * 1000000 + k) AS room FROM h GROUP BY 1""",
    "j21_cascade": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey WHEN c_custkey % 3 = 1 AND c_nationkey % 7 < 5 THEN 'r' || c_nationkey % 7 END AS found FROM customer",
    "j22_target": "SELECT c_nationkey AS b, arg_min(c_name, (c_custkey % 4) * 10000000 + c_custkey) AS name, min(c_custkey % 4) AS priority FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1",
    "j05_hubs": "SELECT c_custkey AS node, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 500 % 2 = 0 AND c_custkey % 500 IN (SELECT p_partkey FROM part) THEN 'waypoint' ELSE ['room', 'door', 'stair'][c_custkey % 3 + 1] END AS type FROM customer",
    "j23_decorate": "SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN 'NATION_' || c_nationkey ELSE 'nation ' || c_nationkey END AS label FROM customer",
    "j06_entrances": """WITH n AS (SELECT c_custkey AS k, c_custkey % 30 AS f, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y FROM customer), m AS (SELECT max(k) AS m FROM n),
      i AS (SELECT a.k, CASE WHEN a.k >= 30 THEN a.k - 30 WHEN a.k + 30 <= m THEN a.k + 30 END AS o FROM n a, m WHERE a.k % 5 = 0),
      s AS (SELECT n.k, n.f // 3 AS building, n.f % 3 + 1 AS level, ['alt', 'main', 'emergency'][n.k % 3 + 1] AS access, CASE WHEN n.k % 35 = 0 THEN 91 WHEN o IS NOT NULL THEN (degrees(atan2(n.x - b.x, b.y - n.y)) + 360) % 360 END AS d FROM n JOIN i USING (k) LEFT JOIN n b ON b.k = i.o),
      l AS (SELECT *, CASE WHEN d IS NULL THEN 'Building' ELSE ['North', 'Northeast', 'East', 'Southeast', 'South', 'Southwest', 'West', 'Northwest'][CAST(floor(d / 45 + 0.5) AS BIGINT) % 8 + 1] END AS side FROM s WHERE building < 8),
      o AS (SELECT *, row_number() OVER (PARTITION BY building, side, level ORDER BY ['main', 'alt', 'emergency'].list_position(access), k) AS n FROM l)
      SELECT k AS node, building, access, side || ' entrance' || CASE WHEN n > 1 THEN ' ' || n ELSE '' END || CASE WHEN level > 1 THEN ', level ' || level ELSE '' END AS label FROM o""",
    "j14_stack": """WITH r AS (SELECT n_nationkey AS id, n_nationkey // 5 AS level, n_nationkey % 5 * 150 AS x, n_nationkey * 7 % 40 AS y FROM nation),
      p AS (SELECT a.id, b.id AS other, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM r a JOIN r b ON b.level = a.level + 1 WHERE abs(a.x - b.x) < 200)
      SELECT id, arg_min(other, dx * 1000 + other) AS other FROM p GROUP BY 1""",
    "j15_runs": """WITH f AS (SELECT DISTINCT user_id, minute(ts) AS h FROM events WHERE value > 15), n AS (SELECT user_id, count(*) AS c FROM f GROUP BY 1),
      g AS (SELECT user_id, h + 60 * k AS h FROM f, (VALUES (0), (1)) t(k)), i AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS r FROM g),
      runs AS (SELECT user_id, min(h) AS s, count(*) AS n FROM i GROUP BY user_id, r)
      SELECT user_id, s AS start, n FROM runs JOIN n USING (user_id) WHERE n >= 3 AND c < 60 AND s < 60 AND NOT (s = 0 AND EXISTS (SELECT 1 FROM f WHERE f.user_id = runs.user_id AND f.h = 59)) UNION ALL SELECT user_id, 0, 60 FROM n WHERE c = 60""",
    "j16_nearest": """WITH g AS (SELECT c_custkey AS gap, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT c_custkey AS swing, c_custkey * 53 % 1000 AS sx, c_custkey * 29 % 1000 AS sy FROM customer WHERE c_custkey % 3 = 1),
      d AS (SELECT gap, swing, row_number() OVER (PARTITION BY gap ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), swing) AS r FROM g, s WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 900), b AS (SELECT gap, swing FROM d WHERE r = 1)
      SELECT g.gap, b.swing FROM g LEFT JOIN b USING (gap) UNION ALL SELECT NULL, swing FROM s WHERE swing NOT IN (SELECT swing FROM b)""",
    "j17_infer": """WITH r AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS a, k + 1 AS b, k % 9 + 1 AS len FROM r UNION ALL SELECT k, k + 3, k % 5 + 1 FROM r), f AS (SELECT * FROM e WHERE b IN (SELECT k FROM r)),
      s AS (SELECT a AS room, b AS other, len FROM f UNION ALL SELECT b, a, len FROM f)
      SELECT room, arg_max(other, len * CASE WHEN other % 3 = 0 THEN 3 ELSE 1 END * 10000000 - other) AS other FROM s WHERE room % 4 = 0 OR room % 5 = 0 GROUP BY 1""",
    "x01_refine": f"{_x01()} SELECT room, kind, why FROM r3",
    "x08_candidates": _CAND,
    "x02_types": """WITH t AS (SELECT p_partkey, p_partkey AS k, p_partkey % 600 AS a, p_partkey % 120 + 1 AS r, (p_partkey % 20) || '00' AS number, CASE WHEN p_partkey % 13 = 0 THEN p_partkey % 3 ELSE 0 END AS w, (p_partkey % 600) * 144.0 / ((p_partkey % 120 + 1) * (p_partkey % 120 + 1)) AS el FROM part)
      SELECT p_partkey, CASE WHEN k % 17 = 0 THEN 'stair' WHEN k % 9 = 0 THEN 'mechanical' WHEN w >= 1 THEN 'restroom' WHEN a >= 80 AND ((r <= 72 AND el >= 14) OR (r <= 96 AND el >= 8 AND k % 5 >= 3)) THEN 'corridor' WHEN a < 30 THEN 'storage' ELSE 'other' END AS type,
        CASE WHEN k % 17 = 0 THEN 'treads' WHEN k % 9 = 0 THEN 'AREA-CHAS chase polygon' WHEN w >= 1 THEN w || ' toilet/urinal fixture block(s)' WHEN a >= 80 AND r <= 72 AND el >= 14 THEN 'narrow and long (inradius ' || r || ' in, area/inradius^2 ' || CAST(floor(el + 0.5) AS BIGINT) || ')'
          WHEN a >= 80 AND r <= 96 AND el >= 8 AND k % 5 >= 3 THEN 'circulation number ' || number || ' with elongated shape and ' || (k % 5) || ' openings' WHEN a < 30 THEN 'under 30 sf (' || a || ' sf): closet' ELSE 'no use text in the DWG and no geometric evidence' END AS why FROM t""",
    "m24_scores": """SELECT p_partkey, CAST(floor((0.35 * [1, 0.5, 0.3, 0.15, 0.1][p_partkey % 5 + 1]::DOUBLE + 0.2 * CASE WHEN p_partkey % 80 >= 60 THEN 1 WHEN p_partkey % 80 >= 42 THEN 0.6 ELSE 0.3 END::DOUBLE + 0.3 * greatest(0, 1 - (p_partkey % 50 + CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END) / 40.0::DOUBLE)
      + 0.15 * CASE WHEN p_partkey % 50 < 3 THEN 1 WHEN p_partkey % 3 = 0 THEN 0 ELSE greatest(0, cos(radians(p_partkey % 360 - p_partkey * 7 % 360))) END) * 10000 + 0.5) AS DOUBLE) / 10000 AS score FROM part""",
    "m23_outward": "SELECT n_nationkey, CAST(floor(-20 / sqrt(32800::DOUBLE) * 10000 + 0.5) AS DOUBLE) / 10000 AS x, CAST(floor(-180 / sqrt(32800::DOUBLE) * 10000 + 0.5) AS DOUBLE) / 10000 AS y FROM nation",
    "x05_x06_segments": """WITH s AS (SELECT c_nationkey, c_custkey AS seg, CAST(c_custkey * 7 % 50 AS DOUBLE) AS y, CAST(c_custkey * 13 % 200 AS DOUBLE) AS x0, CAST(c_custkey * 13 % 200 + 10 + c_custkey % 30 AS DOUBLE) AS x1 FROM customer),
      a AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY c_nationkey, y ORDER BY x0, x1, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS n FROM s), b AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey, y ORDER BY x0, x1, seg ROWS UNBOUNDED PRECEDING) AS r FROM a),
      m AS (SELECT c_nationkey, count(*) AS n_merged, sum(d) AS total FROM (SELECT c_nationkey, max(x1) - min(x0) AS d FROM b GROUP BY c_nationkey, y, r) GROUP BY 1),
      p AS (SELECT l.c_nationkey, count(*) AS n_pairs FROM s l JOIN s h ON l.c_nationkey = h.c_nationkey AND h.y - l.y BETWEEN 3 AND 6 AND least(l.x1, h.x1) - greatest(l.x0, h.x0) >= 8 GROUP BY 1)
      SELECT c_nationkey, n_merged, total, n_pairs FROM m LEFT JOIN p USING (c_nationkey)""",
    "x03_procrustes": "SELECT DISTINCT c_nationkey, CAST(c_nationkey * 10 % 360 AS DOUBLE) AS degrees, 2.0::DOUBLE AS scale, CAST(c_nationkey AS DOUBLE) AS dx, -5.0::DOUBLE AS dy FROM customer",
}
