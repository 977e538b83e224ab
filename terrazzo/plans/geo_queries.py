"""Queries of geometry and spatial joins: customers as points, one skewed ring a nation, suppliers' path as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazzo.functions import geo as G
from terrazzo.operators import spatial as S
from terrazzo.session import table

CELL = 100.0


def points(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", G.point(F.col("c_custkey") * 37 % 1000 + 0.25, F.col("c_custkey") * 91 % 1000 + 0.5).alias("p"))


def rings(spark, sf):
    """A quadrilateral on its cell of a 5 x 5 grid of 200 units, of which one corner is pulled in."""
    n = F.col("n_nationkey")
    x, y = n % 5 * 200.0, F.floor(n / 5) * 200.0
    at = lambda dx, dy: G.point(x + dx, y + dy)
    return table(spark, sf, "nation").select("n_nationkey", (n % 3).alias("rank"), F.array(at(10.0, 20.0), at(190.0, 0.0), at(150.0 - n, 170.0), at(0.0, 190.0 + n)).alias("ring"))


def segments(spark, sf):
    s = F.col("s_suppkey")
    at = lambda k: G.point(k * 137 % 1000, k * 211 % 1000)
    return table(spark, sf, "supplier").select("s_suppkey", at(s).alias("a"), at(s + 1).alias("b"), F.when(s % 2 == 0, "road").otherwise("path").alias("kind"))


def r(c, d=4):
    return G.half_up(c, d)


def m01_m03_earth(spark, sf):
    k = F.col("c_custkey")
    lat1, lng1, lat2, lng2 = k % 120 - 60.5, k % 300 - 150.25, (k * 7) % 120 - 60.0, (k * 11) % 300 - 150.0
    m_lat, m_lng = G.meters_per_degree(lat1)
    xy = G.local_xy(lat1 + 0.01, lng1 + 0.02, lat1, lng1)
    tx, ty = G.tile(lat1, lng1, 12)
    back = G.local_lat_lng(xy, lat1, lng1)
    return table(spark, sf, "customer").select(
        "c_custkey",
        r(G.haversine(lat1, lng1, lat2, lng2), 2).alias("m01"),
        r(m_lat, 3).alias("m02_lat"),
        r(m_lng, 3).alias("m02_lng"),
        r(xy["x"], 3).alias("m02_x"),
        r(back["y"] - lat1, 4).alias("m02_back"),
        tx.cast("long").alias("m03_x"),
        ty.cast("long").alias("m03_y"),
        r(G.tile_bounds(tx, ty, 12)["west"], 4).alias("m03_west"),
        r(G.tile_bounds(tx, ty, 12)["north"], 4).alias("m03_north"),
        r(G.bearing(lat1, lng1, lat2, lng2), 3).alias("m17"),
    )


_LL = "(SELECT c_custkey, c_custkey % 120 - 60.5::DOUBLE AS a, c_custkey % 300 - 150.25::DOUBLE AS b, (c_custkey * 7) % 120 - 60.0::DOUBLE AS c, (c_custkey * 11) % 300 - 150.0::DOUBLE AS d FROM customer)"


def _h(e, d):
    return f"CAST(floor(({e}) * {10**d} + 0.5) AS DOUBLE) / {10**d}"


_MLAT = "(111132.92 - 559.82 * cos(2 * radians(a)) + 1.175 * cos(4 * radians(a)) - 0.0023 * cos(6 * radians(a)))::DOUBLE"
_MLNG = "(111412.84 * cos(radians(a)) - 93.5 * cos(3 * radians(a)) + 0.118 * cos(5 * radians(a)))::DOUBLE"
_EARTH = f"""
SELECT c_custkey, {_h('2 * 6371008.8::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))', 2)} AS m01,
 {_h(_MLAT, 3)} AS m02_lat, {_h(_MLNG, 3)} AS m02_lng, {_h(f'((b + 0.02::DOUBLE) - b) * {_MLNG}', 3)} AS m02_x, 0.01::DOUBLE AS m02_back,
 x AS m03_x, y AS m03_y, {_h('x / 4096 * 360 - 180', 4)} AS m03_west, {_h('degrees(atan(sinh(pi() * (1 - 2 * y::DOUBLE / 4096))))', 4)} AS m03_north,
 {_h('(degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) + 360) % 360', 3)} AS m17
FROM (SELECT *, CAST(floor((b + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(a)) + 1 / cos(radians(a))) / pi()) / 2 * 4096) AS BIGINT) AS y FROM {_LL})"""


def m04_m29_rings(spark, sf):
    ring = F.col("ring")
    c = G.centroid(ring)
    env = G.envelope(ring)
    box = F.struct(F.lit(100.0).alias("min_x"), F.lit(100.0).alias("min_y"), F.lit(350.0).alias("max_x"), F.lit(350.0).alias("max_y"))
    return rings(spark, sf).select(
        "n_nationkey",
        r(G.signed_area(ring)).alias("m04"),
        r(c["x"]).alias("m05_x"),
        r(c["y"]).alias("m05_y"),
        r(G.perimeter(ring)).alias("m29"),
        r(G.perimeter(ring, False)).alias("m29_open"),
        F.size(G.sample_ring(ring, 25.0)).cast("long").alias("m09"),
        r(G.box_overlap(env, box)).alias("m28"),
        r(G.distance_outside(c, *(F.lit(v) for v in (100.0, 100.0, 350.0, 350.0)))).alias("m26"),
        F.size(G.clean_ring(F.concat(ring, F.slice(ring, 4, 1), F.slice(ring, 1, 1)), 1.0)).cast("long").alias("m13"),
        r(G.shaft_area(F.reverse(ring))).alias("r15"),
    )


_R = """r AS (SELECT n_nationkey AS n, n_nationkey % 3 AS rank, CAST(n_nationkey % 5 * 200 AS DOUBLE) AS x, CAST(n_nationkey // 5 * 200 AS DOUBLE) AS y FROM nation),
v AS (SELECT n, rank, 1 AS i, x + 10 AS px, y + 20 AS py FROM r UNION ALL SELECT n, rank, 2, x + 190, y FROM r UNION ALL SELECT n, rank, 3, x + 150 - n, y + 170 FROM r UNION ALL SELECT n, rank, 4, x, y + 190 + n FROM r),
e AS (SELECT a.n, a.rank, a.i, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS yb FROM v a JOIN v b ON a.n = b.n AND b.i = a.i % 4 + 1)"""
_RINGS = f"""WITH {_R}, g AS (SELECT n, sum(ax * yb - bx * ay) / 2 AS area, sum((ax + bx) * (ax * yb - bx * ay)) AS sx, sum((ay + yb) * (ax * yb - bx * ay)) AS sy,
  sum(sqrt(pow(bx - ax, 2) + pow(yb - ay, 2))) AS per, sum(sqrt(pow(bx - ax, 2) + pow(yb - ay, 2))) FILTER (i < 4) AS per3, sum(greatest(1, ceil(sqrt(pow(bx - ax, 2) + pow(yb - ay, 2)) / 25))) AS k,
  min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY n), c AS (SELECT *, sx / (6 * area) AS cx, sy / (6 * area) AS cy FROM g)
SELECT n AS n_nationkey, {_h('area', 4)} AS m04, {_h('cx', 4)} AS m05_x, {_h('cy', 4)} AS m05_y, {_h('per', 4)} AS m29, {_h('per3', 4)} AS m29_open, CAST(k AS BIGINT) AS m09,
 {_h('greatest(0, least(x1, 350) - greatest(x0, 100)) * greatest(0, least(y1, 350) - greatest(y0, 100))', 4)} AS m28,
 {_h('sqrt(pow(greatest(100 - cx, 0, cx - 350), 2) + pow(greatest(100 - cy, 0, cy - 350), 2))', 4)} AS m26, CAST(4 AS BIGINT) AS m13, {_h('abs(area)', 4)} AS r15 FROM c"""


def m06_in_ring(spark, sf):
    return S.points_in_rings(points(spark, sf), rings(spark, sf), CELL).select("c_custkey", "n_nationkey")


_IN = f"""WITH {_R}, p AS (SELECT c_custkey, c_custkey * 37 % 1000 + 0.25::DOUBLE AS x, c_custkey * 91 % 1000 + 0.5::DOUBLE AS y FROM customer),
q AS (SELECT c_custkey, n, rank, count(*) FILTER ((ay > y) <> (yb > y) AND x < (bx - ax) * (y - ay) / (yb - ay) + ax) % 2 = 1 AS inside,
  min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (yb - ay), 2))) AS d FROM
  (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / (pow(bx - ax, 2) + pow(yb - ay, 2)))) AS t FROM p, e) GROUP BY ALL)"""


def j04_strictest(spark, sf):
    s = S.strictest(points(spark, sf), rings(spark, sf), "c_custkey", "rank", CELL, 12.0)
    return s.select("c_custkey", F.col("rank").cast("long").alias("rank"))


def m08_distance(spark, sf):
    p, ring = F.col("p"), F.col("ring")
    near = lambda at: S.in_reach(at, rings(spark, sf), G.envelope(ring), CELL, 30.0).where(G.ring_distance(p, ring) <= 30).select("p", "n_nationkey", r(G.signed_ring_distance(p, ring)).alias("d"))
    return S.per_place(points(spark, sf), ["p"], near).select("c_custkey", "n_nationkey", "d")


def j08_nearest(spark, sf):
    n = S.nearest_segments(points(spark, sf), segments(spark, sf), "c_custkey", "s_suppkey", CELL, 60.0, 3)
    return n.select("c_custkey", "s_suppkey", r(F.col("dist")).alias("dist"), F.col("place").cast("long").alias("place"))


def j09_nearest_one(spark, sf):
    n = S.nearest_segments(points(spark, sf), segments(spark, sf).where("kind = 'path'"), "c_custkey", "s_suppkey", CELL, 60.0)
    return n.select("c_custkey", "s_suppkey", r(F.col("dist")).alias("dist"), r(F.col("t")).alias("t"))


def _seg_sql(where="TRUE"):
    return f"""WITH s AS (SELECT s_suppkey AS s, CAST(s_suppkey * 137 % 1000 AS DOUBLE) AS ax, CAST(s_suppkey * 211 % 1000 AS DOUBLE) AS ay, CAST((s_suppkey + 1) * 137 % 1000 AS DOUBLE) AS bx, CAST((s_suppkey + 1) * 211 % 1000 AS DOUBLE) AS yb, CASE WHEN s_suppkey % 2 = 0 THEN 'road' ELSE 'path' END AS kind FROM supplier),
p AS (SELECT c_custkey AS c, c_custkey * 37 % 1000 + 0.25::DOUBLE AS x, c_custkey * 91 % 1000 + 0.5::DOUBLE AS y FROM customer WHERE c_custkey < 1000),
t AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / (pow(bx - ax, 2) + pow(yb - ay, 2)))) AS t FROM p, s WHERE {where}),
d AS (SELECT *, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (yb - ay), 2)) AS d FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, s) AS place FROM d WHERE d <= 60)"""


def j11_snap(spark, sf):
    segs = segments(spark, sf)
    t = segs.select("s_suppkey", "a", "b", F.lit(2).alias("rank")).unionByName(segs.select((F.col("s_suppkey") + 10**6).alias("s_suppkey"), "a", F.col("a").alias("b"), F.lit(1).alias("rank")))
    s = S.snap(points(spark, sf), t, "c_custkey", "s_suppkey", CELL, 40.0)
    return s.select("c_custkey", "s_suppkey", r(F.col("dist")).alias("dist"))


def j10_connect(spark, sf):
    p = points(spark, sf).withColumn("home", (F.col("c_custkey") % 25).cast("int"))
    outlines = rings(spark, sf).select(F.col("n_nationkey").alias("home"), "ring")
    c = S.connect(p, segments(spark, sf), outlines, "c_custkey", "s_suppkey", CELL, 60.0)
    return c.select("c_custkey", "s_suppkey", r(F.col("dist")).alias("dist"))


def m25_blocked(spark, sf):
    p = points(spark, sf).select(F.col("c_custkey").alias("id"), "p", G.point(F.col("p.x") + 40, F.col("p.y") + 25).alias("q"))
    return S.blocked(p, segments(spark, sf).select(F.col("a").alias("wa"), F.col("b").alias("wb")), CELL).select("id")


def r14_inside(spark, sf):
    k = F.col("c_custkey")
    segs = points(spark, sf).select("c_custkey", F.col("p").alias("a"), G.point(F.col("p.x") + 30, F.col("p.y") + k % 40).alias("b"))
    return S.segments_inside(segs, rings(spark, sf), "c_custkey", "n_nationkey", CELL, 5.0)


def j07_match(spark, sf):
    from terrazzo.functions.text import name_tokens

    names = ["Red Hall", "Blue Center", "Old School", "Red Gym", ""]
    pick = lambda k: F.element_at(F.array(*map(F.lit, names)), (k % 5 + 1).cast("int"))
    shapes = rings(spark, sf).select("n_nationkey", "ring", name_tokens(pick(F.col("n_nationkey"))).alias("tokens"))
    seeds = points(spark, sf).select("c_custkey", "p", name_tokens(pick(F.col("c_custkey"))).alias("tokens"))
    return S.match_entities(shapes, seeds, "n_nationkey", "c_custkey", "c_custkey", 200.0).select("n_nationkey", "c_custkey", "score", "inside")


def m10_m22_shapes(spark, sf):
    """Crossing, arcs, placement and the plan frame with its inverse, one row a supplier."""
    s = segments(spark, sf)
    k = F.col("s_suppkey")
    t = F.struct(F.lit(36.6).alias("origin_lat"), F.lit(-88.3).alias("origin_lng"), (k % 360).cast("double").alias("degrees"), F.lit(0.05).alias("unit"), (k % 2 == 0).alias("reflected"))
    off = G.point(F.lit(3), F.lit(-2))
    q = G.plan_to_lng_lat(F.col("a"), t, off)
    back = G.lng_lat_to_plan(q, t, off)
    ins = G.insert_transform(F.col("a"), F.lit(2.0), F.lit(-1.0), F.lit(90.0), F.lit(10.0), k)
    return s.select(
        "s_suppkey",
        G.segments_intersect(F.col("a"), F.col("b"), G.point(F.lit(0), F.lit(500.25)), G.point(F.lit(1000), F.lit(500.25))).alias("m10"),
        F.size(G.arc_points(F.col("a"), F.lit(5.0), F.lit(0.0), F.lit(1.0))).cast("long").alias("m11_n"),
        r(G.perimeter(G.bulge_arc(G.point(F.lit(0), F.lit(0)), G.point(F.lit(10), F.lit(0)), F.lit(1.0), 1.0), False), 2).alias("m11_half_circle"),
        r(ins["x"]).alias("m15_x"),
        r(ins["y"]).alias("m15_y"),
        r(back["x"], 3).alias("m16_x"),
        r(back["y"], 3).alias("m16_y"),
        r(G.plan_bearing(F.lit(0.0), F.lit(-1.0), t), 3).alias("m16_up"),
        F.size(G.circle(F.col("a"), 5.0, 48)).cast("long").alias("m18"),
        r(G.area(F.slice(G.cone(F.col("a"), k.cast("double"), 10.0, 60.0), 1, 10)), 3).alias("m18_cone"),
        G.label_fits(k % 40, F.lit(10.0), F.lit(100.0), F.lit(20.0)).alias("m31"),
    )


_SHAPES = f"""SELECT s_suppkey, (s_suppkey * 211 % 1000 > 500.25) <> ((s_suppkey + 1) * 211 % 1000 > 500.25) AS m10, CAST(7 AS BIGINT) AS m11_n, 15.71::DOUBLE AS m11_half_circle,
 {_h('s_suppkey * 211 % 1000 + 10', 4)} AS m15_x, {_h('s_suppkey * 137 % 1000 * 2 + s_suppkey', 4)} AS m15_y,
 CAST(s_suppkey * 137 % 1000 AS DOUBLE) AS m16_x, CAST(s_suppkey * 211 % 1000 AS DOUBLE) AS m16_y, CAST((360 - s_suppkey % 360) % 360 AS DOUBLE) AS m16_up, CAST(49 AS BIGINT) AS m18,
 {_h('8 * 50 * sin(radians(7.5))', 3)} AS m18_cone, s_suppkey % 40 * 6 <= 100 AS m31 FROM supplier"""


def m19_iou(spark, sf):
    box = F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((100, 100), (300, 100), (300, 300), (100, 300))))
    return rings(spark, sf).where("n_nationkey in (0, 1, 5, 6)").select("n_nationkey", r(G.ring_iou(F.col("ring"), box, 40), 1).alias("iou"))


def m12_m20_arrow(spark, sf):
    """Simplified lines, poles and hulls, in Arrow functions."""
    simplify, pole, hull = G.arrow_functions()
    x = rings(spark, sf).withColumn("dense", G.sample_ring(F.col("ring"), 7.0))
    x = x.select("n_nationkey", "ring", simplify("dense", F.lit(0.01)).alias("s"), pole("ring", F.lit(0.01)).alias("p"), hull("dense").alias("h"))
    return x.select("n_nationkey", F.size("s").cast("long").alias("n"), r(F.col("p.d"), 1).alias("inradius"), r(G.area(F.col("h")) / G.area(F.col("ring")), 6).alias("convexity"))


QUERIES = {f.__name__: f for f in (m01_m03_earth, m04_m29_rings, m06_in_ring, j04_strictest, m08_distance, j08_nearest, j09_nearest_one, j11_snap, j10_connect, m25_blocked, r14_inside, j07_match, m10_m22_shapes, m19_iou, m12_m20_arrow)}
ORACLE = {
    "m01_m03_earth": _EARTH,
    "m04_m29_rings": _RINGS,
    "m06_in_ring": f"{_IN} SELECT c_custkey, n AS n_nationkey FROM q WHERE inside",
    "j04_strictest": f"{_IN} SELECT customer.c_custkey, CAST(max(rank) AS BIGINT) AS rank FROM customer LEFT JOIN q ON q.c_custkey = customer.c_custkey AND (inside OR d <= 12) GROUP BY 1",
    "m08_distance": f"{_IN} SELECT c_custkey, n AS n_nationkey, {_h('CASE WHEN inside THEN d ELSE -d END', 4)} AS d FROM q WHERE d <= 30",
    "j08_nearest": f"{_seg_sql()} SELECT c AS c_custkey, s AS s_suppkey, {_h('d', 4)} AS dist, place FROM n WHERE place <= 3",
    "j09_nearest_one": f"{_seg_sql(chr(107) + 'ind = ' + chr(39) + 'path' + chr(39))} SELECT c AS c_custkey, s AS s_suppkey, {_h('d', 4)} AS dist, {_h('t', 4)} AS t FROM n WHERE place = 1",
    "j11_snap": f"""{_seg_sql()}, v AS (SELECT c, s + 1000000 AS s, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS d, 1 AS rank FROM p, s UNION ALL SELECT c, s, d, 2 FROM d),
      w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rank, d, s) AS r FROM v WHERE d <= 40) SELECT c AS c_custkey, s AS s_suppkey, {_h('d', 4)} AS dist FROM w WHERE r = 1""",
    "m25_blocked": f"""{_seg_sql()}, o AS (SELECT c, sign((x2 - x) * (ay - y) - (y2 - y) * (ax - x)) AS o1, sign((x2 - x) * (yb - y) - (y2 - y) * (bx - x)) AS o2, sign((bx - ax) * (y - ay) - (yb - ay) * (x - ax)) AS o3, sign((bx - ax) * (y2 - ay) - (yb - ay) * (x2 - ax)) AS o4
      FROM (SELECT *, x + 40 AS x2, y + 25 AS y2 FROM p, s WHERE c < 300)) SELECT DISTINCT c AS id FROM o WHERE o1 * o2 <= 0 AND o3 * o4 <= 0""",
    "r14_inside": f"""{_IN.replace('p AS (SELECT c_custkey, c_custkey * 37 % 1000 + 0.25::DOUBLE AS x, c_custkey * 91 % 1000 + 0.5::DOUBLE AS y FROM customer)', 'p AS (SELECT c_custkey * 2 AS c_custkey, c_custkey * 37 % 1000 + 0.25::DOUBLE AS x, c_custkey * 91 % 1000 + 0.5::DOUBLE AS y FROM customer UNION ALL SELECT c_custkey * 2 + 1, c_custkey * 37 % 1000 + 30.25::DOUBLE, c_custkey * 91 % 1000 + 0.5::DOUBLE + c_custkey % 40 FROM customer)')}
      SELECT c_custkey // 2 AS c_custkey, n AS n_nationkey FROM q WHERE inside OR d <= 5 GROUP BY 1, 2 HAVING count(*) = 2""",
    "m10_m22_shapes": _SHAPES,
}
