"""Queries of graph operators on suppliers as nodes: a broken chain with cross edges, classes and floors from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazzo.operators import graph as G
from terrazzo.operators import unified as U
from terrazzo.session import table


def nodes(spark, sf):
    k = F.col("s_suppkey")
    access = F.when(k % 13 == 12, "emergency").otherwise("main")
    return table(spark, sf, "supplier").select(k.alias("node"), access.alias("access"), (k % 4 == 0).alias("outdoor"), (k * 37 % 100).cast("double").alias("x"), (k * 91 % 100).cast("double").alias("y"), (k % 3).alias("floor"), F.when(k % 5 == 0, k).alias("room"))


def edges(spark, sf):
    """k to k + 1 but for every tenth, and k to 3k + 1 where that is a node, for k not divisible by 3."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"))
    ids = s.withColumnRenamed("a", "b")
    chain = s.where("a % 10 <> 9").withColumn("b", F.col("a") + 1)
    cross = s.where("a % 3 <> 0").withColumn("b", F.col("a") * 3 + 1)
    e = chain.unionByName(cross).join(ids, "b", "left_semi")
    key = F.col("a") + F.col("b")
    return e.select((F.col("a") * 100000 + F.col("b")).alias("edge"), "a", "b", (key % 5 + 1).cast("double").alias("length"), F.when(key % 7 == 0, "alt").when(key % 17 == 0, "emergency").otherwise("main").alias("access"), (key % 4 != 0).alias("accessible"), (key % 6 == 0).alias("door"))


_E = """e AS (SELECT a, b, CAST((a + b) % 5 + 1 AS INT) AS length, CASE WHEN (a + b) % 7 = 0 THEN 'alt' WHEN (a + b) % 17 = 0 THEN 'emergency' ELSE 'main' END AS access, (a + b) % 4 <> 0 AS accessible, (a + b) % 6 = 0 AS door
  FROM (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 10 <> 9 UNION ALL SELECT s_suppkey, s_suppkey * 3 + 1 FROM supplier WHERE s_suppkey % 3 <> 0) WHERE b IN (SELECT s_suppkey FROM supplier))"""


def _reach(where: str) -> str:
    return f"""WITH RECURSIVE {_E}, n AS (SELECT s_suppkey AS node, s_suppkey % 13 = 12 AS closed FROM supplier), u AS (SELECT a, b FROM e WHERE {where} UNION SELECT b, a FROM e WHERE {where}),
r(node, other) AS (SELECT node, node FROM n UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a),
c AS (SELECT node, min(other) AS component FROM r GROUP BY 1)"""


_OPEN = "access <> 'emergency' AND a % 13 <> 12 AND b % 13 <> 12"


def g01_components(spark, sf):
    return G.node_components(nodes(spark, sf), edges(spark, sf).where("access = 'main'"))


def g01_ranked(spark, sf):
    c = G.component_sizes(G.node_components(nodes(spark, sf), edges(spark, sf).where("access = 'main'")), 5)
    return c.select("component", "size", F.col("rank").cast("long").alias("rank"))


def j26_prune(spark, sf):
    return G.prune(nodes(spark, sf), edges(spark, sf).where("length < 3"), nodes(spark, sf).where("node % 25 = 0"))


def _check(spark, sf):
    n = nodes(spark, sf)
    rooms = n.where("node % 5 = 0").select(F.concat(F.lit("r"), "node").alias("room"), "node")
    buildings = n.where("node % 7 < 2").select(F.concat(F.lit("b"), F.floor(F.col("node") / 7)).alias("building"), "node")
    return G.check_connectivity(n, edges(spark, sf), rooms, buildings)


def g02_components(spark, sf):
    return _check(spark, sf)[0].select("component", "size", "outdoor", "rooms", "buildings")


def g02_unreachable(spark, sf):
    labels = nodes(spark, sf).where("node % 10 = 0").select(F.concat(F.lit("r"), "node").alias("id"), F.concat(F.lit("Room "), "node").alias("label"))
    return G.describe(_check(spark, sf)[1], labels)


_CHECK = f"""{_reach(_OPEN)}, o AS (SELECT c.* FROM c JOIN n USING (node) WHERE NOT closed),
rooms AS (SELECT 'r' || node AS room, node FROM n WHERE node % 5 = 0), bs AS (SELECT 'b' || node // 7 AS building, node FROM n WHERE node % 7 < 2),
st AS (SELECT component, count(*) AS size, count(*) FILTER (node % 4 = 0) AS outdoor, count(*) FILTER (node % 5 = 0) AS rooms, count(DISTINCT CASE WHEN node % 7 < 2 THEN node // 7 END) AS buildings FROM o GROUP BY 1),
st2 AS (SELECT * FROM st WHERE rooms > 0 OR buildings > 0), m AS (SELECT component FROM st2 ORDER BY outdoor DESC, rooms DESC, size DESC, component LIMIT 1),
lost AS (SELECT 'room' AS kind, room AS id FROM rooms WHERE room NOT IN (SELECT room FROM rooms JOIN o USING (node) WHERE component IN (FROM m))
 UNION ALL SELECT DISTINCT 'building', building FROM bs WHERE building NOT IN (SELECT building FROM bs JOIN o USING (node) WHERE component IN (FROM m)))"""


def g03_split(spark, sf):
    li = table(spark, sf, "lineitem")
    cuts = li.groupBy((F.col("l_suppkey") * 100000 + F.col("l_suppkey") + 1).alias("edge"), (F.col("l_linenumber") * 0.6).alias("at")).agg(F.min("l_partkey").alias("node"))
    p = G.split_edges(edges(spark, sf), cuts)
    return p.select("edge", F.col("part").cast("long").alias("part"), "a", "b", (F.floor(F.col("length") * 100 + 0.5) / 100).alias("length"))


def _ends(spark, sf):
    n = nodes(spark, sf)
    starts = n.where("node % 20 = 1").select((F.floor(F.col("node") / 40)).alias("query"), "node", (F.col("node") % 3).cast("double").alias("offset"))
    goals = n.where("node % 20 = 8").select((F.floor(F.col("node") / 40)).alias("query"), "node", (F.col("node") % 2).cast("double").alias("offset"))
    return starts, goals


def g11_routes(spark, sf):
    p = G.find_paths(G.route_edges(edges(spark, sf), alt_factor=2.0, side_door_cost=4.0), *_ends(spark, sf))
    return p.select("query", "cost")


def g14_g15_routes(spark, sf):
    e = edges(spark, sf)
    avoid = nodes(spark, sf).where("node % 11 = 5").select("node")
    p = G.find_paths(G.route_edges(e, alt_factor=0.5, step_free=True, avoid_nodes=avoid, avoid_edges=e.where("edge % 9 = 0").select("edge")), *_ends(spark, sf))
    return p.select("query", "cost")


def _routes(weight: str, where: str) -> str:
    return f"""WITH RECURSIVE {_E}, d AS (SELECT a AS src, b AS dst, {weight} AS w FROM e WHERE {where} UNION ALL SELECT b, a, {weight} FROM e WHERE {where}),
p(query, node, cost) AS (SELECT CAST(s_suppkey // 40 AS BIGINT), s_suppkey, CAST(s_suppkey % 3 AS INT) FROM supplier WHERE s_suppkey % 20 = 1
 UNION SELECT query, dst, cost + w FROM p JOIN d ON node = src WHERE cost + w <= 90)
SELECT query, CAST(min(cost + node % 2) AS DOUBLE) AS cost FROM p WHERE node % 20 = 8 AND node // 40 = query GROUP BY 1"""


def _nodes_with_degree(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    d = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return n.join(d, "node", "left").fillna(0, ["degree"])


def g16_routes(spark, sf):
    p = G.find_simple_routes(G.route_edges(edges(spark, sf), alt_factor=2.0), _nodes_with_degree(spark, sf), *_ends(spark, sf), turn_cost=3.0, floor_cost=5.0, junction_cost=2.0, room_cost=4.0)
    return p.select("query", "cost")


_G16 = f"""WITH RECURSIVE {_E}, deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
n AS (SELECT s_suppkey AS node, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 100 AS DOUBLE) AS y, s_suppkey % 3 AS f, s_suppkey % 5 = 0 AS room, coalesce(degree, 0) AS degree FROM supplier LEFT JOIN deg ON node = s_suppkey),
k AS (SELECT *, length * CASE WHEN access = 'alt' THEN 2 ELSE 1 END AS w FROM e WHERE access <> 'emergency'), d AS (SELECT a AS src, b AS dst, w FROM k UNION ALL SELECT b, a, w FROM k),
t AS (SELECT p.src AS u, p.dst AS v, q.dst AS z, q.w + CASE WHEN nu.f = nv.f AND nv.f = nz.f AND abs((degrees(atan2(nz.y - nv.y, nz.x - nv.x) - atan2(nv.y - nu.y, nv.x - nu.x)) + 540 + 360) % 360 - 180) > 45 THEN 3 ELSE 0 END
  + CASE WHEN nv.f <> nz.f THEN 5 ELSE 0 END + CASE WHEN nv.degree >= 3 THEN 2 ELSE 0 END + CASE WHEN nv.room THEN 4 ELSE 0 END AS w
  FROM d p JOIN d q ON p.dst = q.src AND p.src <> q.dst JOIN n nu ON nu.node = p.src JOIN n nv ON nv.node = p.dst JOIN n nz ON nz.node = q.dst),
r(query, u, v, cost) AS (SELECT src // 40, src, dst, CAST(src % 3 + w AS INT) FROM d WHERE src % 20 = 1 UNION SELECT query, t.v, t.z, CAST(cost + t.w AS INT) FROM r JOIN t ON t.u = r.u AND t.v = r.v WHERE cost + t.w <= 120)
SELECT CAST(query AS BIGINT) AS query, CAST(min(cost + v % 2) AS DOUBLE) AS cost FROM r WHERE v % 20 = 8 AND v // 40 = query GROUP BY 1"""


def g17_confusion(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("path")).where("size(path) > 2")
    return G.confusion(li.withColumnRenamed("l_orderkey", "query"), _nodes_with_degree(spark, sf))


_G17 = f"""WITH {_E}, deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
p AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS node FROM lineitem), z AS (SELECT q FROM p GROUP BY 1 HAVING count(*) > 2),
s AS (SELECT p.*, CAST(p.node * 37 % 100 AS DOUBLE) AS x, CAST(p.node * 91 % 100 AS DOUBLE) AS y, p.node % 3 AS f, coalesce(degree, 0) AS degree FROM p JOIN z USING (q) LEFT JOIN deg USING (node)),
w AS (SELECT *, lag(x) OVER o AS x1, lag(y) OVER o AS y1, lag(x, 2) OVER o AS x2, lag(y, 2) OVER o AS y2, lag(f) OVER o AS f1, lag(f, 2) OVER o AS f2, lag(node) OVER o IS NOT NULL AND lead(node) OVER o IS NOT NULL AS mid FROM s WINDOW o AS (PARTITION BY q ORDER BY node))
SELECT q AS query, count(*) FILTER (f2 = f1 AND f1 = f AND sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) >= 0.75 AND sqrt(pow(x - x1, 2) + pow(y - y1, 2)) >= 0.75 AND abs((degrees(atan2(y - y1, x - x1) - atan2(y1 - y2, x1 - x2)) + 900) % 360 - 180) > 45) AS turns,
 count(*) FILTER (f1 <> f) AS floor_changes, count(*) FILTER (mid AND degree >= 3) AS junctions, count(*) FILTER (mid AND node % 5 = 0) AS rooms FROM w GROUP BY 1"""


def g18_nearest_open(spark, sf):
    n = nodes(spark, sf)
    return G.nearest_open(G.route_edges(edges(spark, sf), alt_factor=1.0, allow_emergency=True), n, n.where("access = 'emergency'")).select("node", "cost")


_G18 = f"""WITH RECURSIVE {_E}, d AS (SELECT a AS src, b AS dst, length AS w FROM e UNION ALL SELECT b, a, length FROM e),
p(q, node, cost) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_suppkey % 13 = 12 UNION SELECT q, dst, cost + w FROM p JOIN d ON node = src WHERE cost + w <= 20)
SELECT q AS node, CAST(min(cost) AS DOUBLE) AS cost FROM p WHERE node % 13 <> 12 GROUP BY 1"""


def g19_nearest_node(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("floor"), (F.col("c_custkey") * 53 % 100).cast("double").alias("x"), (F.col("c_custkey") * 17 % 100).cast("double").alias("y"))
    n = G.nearest_node(c, nodes(spark, sf), "c_custkey")
    return n.select("c_custkey", "node", (F.floor(F.col("dist") * 1000 + 0.5) / 1000).alias("dist"))


def g20_plan(spark, sf):
    starts, goals = _ends(spark, sf)
    p = G.plan_routes(edges(spark, sf), starts, goals, goals.where("node % 40 = 8"), alt_factor=2.0, side_door_cost=4.0)
    return p.select("query", "cost", "front_cost", (F.col("why") == "only").alias("only"))


def g10_union(spark, sf):
    """Suppliers above a third of the keys are indoors, those that end in 0, 5 or 6 outdoors; some are both."""
    k = F.col("node")
    n = nodes(spark, sf).withColumn("type", F.when(k % 10 == 0, "entrance").otherwise("waypoint"))
    kind = F.when(k % 3 == 0, "alt").when(k % 20 == 10, "main").otherwise("emergency")
    indoor = n.where("node % 10 < 4").select("node", "floor", "type", F.when(k % 10 == 0, kind).alias("access"))
    outdoor = n.where("node % 10 in (0, 5, 6)").select("node", F.lit("crossing").alias("type"), F.lit("alt").alias("access"), (k % 90).alias("lat"), (k % 180).alias("lng"))
    return U.unified_nodes(indoor, outdoor, edges(spark, sf).where("b % 10 < 4 and a % 10 < 4"))


def g10_edges(spark, sf):
    e = edges(spark, sf)
    outdoor = e.where("a % 2 = 0").withColumn("kind", F.when(F.col("b") % 3 == 0, "road").when(F.col("b") % 3 == 1, "steps"))
    return U.unified_edges(e.where("a % 2 = 1"), outdoor.withColumn("access", F.when(F.col("b") % 5 == 0, "main"))).select("edge", "access", "accessible", "outdoor")


def _walks(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("path"))
    k = F.col("s_suppkey")
    floor = F.floor(k * 4 / 100) % 4
    named = table(spark, sf, "supplier").select(k.alias("node"), F.when(floor > 0, floor).alias("floor"), floor.alias("level"), F.when(k % 2 == 0, "stair").otherwise("elevator").alias("type"), F.concat(F.lit("door "), k).alias("door"), F.lit("Hall").alias("building"), F.concat(F.lit("Floor "), floor).alias("floor_label"))
    pairs = li.select(F.posexplode("path").alias("at", "a"), "path").select("a", F.get("path", F.col("at") + 1).alias("b")).where("b is not null").distinct().withColumn("length", ((F.col("a") + F.col("b")) % 7 + 0.5).cast("double"))
    return U.route_steps(li.withColumn("destination", F.concat(F.lit("R"), "query")), named, pairs)


def f38_steps(spark, sf):
    return _walks(spark, sf)


def f38_sentences(spark, sf):
    return U.route_sentences(_walks(spark, sf))


def g21_blocked(spark, sf):
    """The routes of g11 again, with the stretch from their starts to the first junction closed."""
    e = G.route_edges(edges(spark, sf), alt_factor=2.0, side_door_cost=4.0)
    starts, goals = _ends(spark, sf)
    first = G.find_paths(e, starts, goals)
    return U.reroute(e, first.select("query", "path", F.lit(0).alias("at")), goals, _nodes_with_degree(spark, sf), blocked=True).select("query", "cost")


QUERIES = {f.__name__: f for f in (g01_components, g01_ranked, j26_prune, g02_components, g02_unreachable, g03_split, g11_routes, g14_g15_routes, g16_routes, g17_confusion, g18_nearest_open, g19_nearest_node, g20_plan, g10_union, g10_edges, f38_steps, f38_sentences, g21_blocked)}
_STEPS = """WITH p AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS k FROM lineitem), n AS (SELECT q, k, k * 4 // 100 % 4 AS f, lead(k) OVER w AS k2, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY q ORDER BY k)),
e AS (SELECT *, k2 * 4 // 100 % 4 AS f2, (k + k2) % 7 + 0.5 AS m FROM n WHERE k2 IS NOT NULL), c AS (SELECT *, CASE WHEN f = 0 OR f2 = 0 THEN 'outdoor' WHEN f <> f2 THEN 'change' ELSE 'walk' END AS kind FROM e),
d AS (SELECT *, kind || CASE WHEN kind = 'walk' THEN CAST(f AS VARCHAR) ELSE '' END AS s FROM c), g AS (SELECT *, sum(CASE WHEN s = lag_s THEN 0 ELSE 1 END) OVER (PARTITION BY q ORDER BY i) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY q ORDER BY i) AS lag_s FROM d)),
r AS (SELECT q, run, min(kind) AS kind, arg_min(f, i) AS f, sum(m)::DOUBLE AS meters, min(k) AS first, max(k2) AS last, arg_max(f2, i) AS f2 FROM g GROUP BY 1, 2),
t AS (SELECT *, lead(kind) OVER v AS after, lead(first) OVER v AS lift, lead(f) OVER v AS lf, lead(f2) OVER v AS lt FROM r WINDOW v AS (PARTITION BY q ORDER BY run)),
x AS (SELECT q, run, 0 AS part, kind, CASE WHEN kind = 'walk' THEN f END AS floor, meters, first, last, CASE WHEN after IS NULL THEN 'Arrive at R' || q WHEN kind = 'outdoor' THEN 'Walk to the door ' || last || ' of Hall' WHEN after = 'outdoor' THEN 'Leave by the door ' || last
    WHEN after = 'change' THEN 'Take the ' || CASE WHEN lift % 2 = 1 THEN 'elevator' ELSE 'stairs' END || CASE WHEN lt > lf THEN ' up' ELSE ' down' END || ' to Floor ' || lt END AS title FROM t WHERE kind <> 'change' OR after IS NULL
  UNION ALL SELECT q, run, 1, 'door', NULL, NULL, last, last, 'Enter by the door ' || last FROM t WHERE kind = 'outdoor' AND after IS NOT NULL),
steps AS (SELECT q AS query, row_number() OVER (PARTITION BY q ORDER BY run, part) AS step, kind, floor, meters, first, last, title FROM x)"""
_W11 = "length * CASE WHEN access = 'alt' THEN 2 ELSE 1 END + CASE WHEN door THEN 4 ELSE 0 END"
_ALL11 = _routes(_W11, "access <> 'emergency'")
ORACLE = {
    "g01_components": f"{_reach(chr(97) + 'ccess = ' + chr(39) + 'main' + chr(39))} SELECT * FROM c",
    "g01_ranked": f"{_reach('access = ' + chr(39) + 'main' + chr(39))} SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM c GROUP BY 1 ORDER BY 3 LIMIT 5",
    "j26_prune": f"{_reach('length < 3')}, t AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT node FROM c WHERE component IN (FROM t) OR component IN (SELECT component FROM c WHERE node % 25 = 0)",
    "g02_components": f"{_CHECK} SELECT component, size, outdoor, rooms, buildings FROM st2",
    "g02_unreachable": f"{_CHECK} SELECT kind, id, 'no way to ' || kind || ' ' || CASE WHEN kind = 'room' AND CAST(substr(id, 2) AS INT) % 10 = 0 THEN 'Room ' || substr(id, 2) ELSE id END AS line FROM lost",
    "g03_split": f"""WITH {_E}, x AS (SELECT a * 100000 + b AS edge, a, b, CAST(length AS DOUBLE) AS length FROM e), k AS (SELECT l_suppkey * 100000 + l_suppkey + 1 AS edge, l_linenumber * 0.6::DOUBLE AS pos, min(l_partkey) AS node FROM lineitem GROUP BY 1, 2),
      c AS (SELECT edge, pos, node FROM k JOIN x USING (edge) WHERE pos > 0.5 AND pos < length - 0.5 UNION ALL SELECT edge, 0, a FROM x UNION ALL SELECT edge, length, b FROM x),
      p AS (SELECT edge, node AS a, lead(node) OVER w AS b, lead(pos) OVER w - pos AS length, row_number() OVER w AS part FROM c WINDOW w AS (PARTITION BY edge ORDER BY pos, node))
      SELECT edge, part, a, b, CAST(floor(length * 100 + 0.5) AS DOUBLE) / 100 AS length FROM p WHERE b IS NOT NULL""",
    "g11_routes": _ALL11,
    "g10_union": f"""WITH RECURSIVE {_E}, i AS (SELECT s_suppkey AS k, s_suppkey % 3 AS floor, CASE WHEN s_suppkey % 10 > 0 THEN 'main' WHEN s_suppkey % 3 = 0 THEN 'alt' WHEN s_suppkey % 20 = 10 THEN 'main' ELSE 'emergency' END AS access FROM supplier WHERE s_suppkey % 10 < 4),
      d AS (SELECT a, b FROM e WHERE access <> 'emergency' AND a IN (SELECT k FROM i WHERE access <> 'emergency') AND b IN (SELECT k FROM i WHERE access <> 'emergency')), u AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
      r(k) AS (SELECT k FROM i WHERE k % 10 = 0 AND access = 'main' UNION SELECT b FROM r JOIN u ON k = a)
      SELECT k AS node, floor, CASE WHEN k % 10 = 0 THEN 'entrance' ELSE 'waypoint' END AS type, access, CASE WHEN k % 10 = 0 THEN k % 90 END AS lat, CASE WHEN k % 10 = 0 THEN k % 180 END AS lng, false AS outdoor, k % 10 = 0 AND access <> 'emergency' AS joined,
        k % 10 = 0 AND access = 'alt' AND k NOT IN (SELECT k FROM r) AS sole_door FROM i
      UNION ALL SELECT s_suppkey, NULL, 'crossing', 'alt', s_suppkey % 90, s_suppkey % 180, true, false, false FROM supplier WHERE s_suppkey % 10 IN (5, 6)""",
    "g10_edges": f"""WITH {_E} SELECT a * 100000 + b AS edge, CASE WHEN a % 2 = 1 THEN access WHEN b % 5 = 0 THEN 'main' WHEN b % 3 = 0 THEN 'alt' ELSE 'main' END AS access, accessible AND NOT (a % 2 = 0 AND b % 3 = 1) AS accessible, a % 2 = 0 AS outdoor FROM e""",
    "f38_steps": f"{_STEPS} SELECT * FROM steps",
    "f38_sentences": f"""{_STEPS}, y AS (SELECT *, CASE WHEN kind = 'outdoor' THEN 'walk ' || CAST(floor(meters + 0.5) AS BIGINT) || ' m along the path' || CASE WHEN title LIKE 'Arrive%' THEN ', ' || lower(title[1]) || substr(title, 2) ELSE '' END ELSE lower(title[1]) || substr(title, 2) END AS s FROM steps)
      SELECT query, upper(z[1]) || substr(z, 2) || '.' AS sentence FROM (SELECT query, string_agg(s, ', ' ORDER BY step) AS z FROM y GROUP BY 1)""",
    "g14_g15_routes": _routes("length", "access <> 'emergency' AND accessible AND a % 11 <> 5 AND b % 11 <> 5 AND (a * 100000 + b) % 9 <> 0"),
    "g16_routes": _G16,
    "g17_confusion": _G17,
    "g18_nearest_open": _G18,
    "g19_nearest_node": """SELECT c_custkey, arg_min(node, [d, node]) AS node, CAST(floor(min(d) * 1000 + 0.5) AS DOUBLE) / 1000 AS dist FROM (SELECT c_custkey, s_suppkey AS node, sqrt(pow(c_custkey * 53 % 100 - s_suppkey * 37 % 100, 2) + pow(c_custkey * 17 % 100 - s_suppkey * 91 % 100, 2)) AS d FROM customer, supplier WHERE c_custkey % 3 = s_suppkey % 3) GROUP BY 1""",
    "g20_plan": f"SELECT a.query, a.cost, f.cost AS front_cost, f.cost IS NULL AS only FROM ({_ALL11}) a LEFT JOIN ({_ALL11.replace('node % 20 = 8', 'node % 40 = 8')}) f ON a.query = f.query",
}
