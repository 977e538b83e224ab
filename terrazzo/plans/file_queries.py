"""Queries of sources, sinks and what is left of the inventory, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazzo.functions import geo as G
from terrazzo.operators import graph as GR
from terrazzo.operators import merge as M
from terrazzo.operators import ordered as O
from terrazzo.session import table
from terrazzo.sources import files as S


def s14_lines(spark, sf):
    n = table(spark, sf, "nation")
    return S.lines(n, "n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")))


def s16_features(spark, sf):
    k = F.col("c_custkey")
    f = S.feature(F.lit("Point"), F.array((k * 37 % 1000).cast("long"), (k * 91 % 1000).cast("long")), F.struct(F.col("c_name").alias("name")))
    return table(spark, sf, "customer").select("c_custkey", f.alias("feature"))


def s17_flatten(spark, sf):
    n = S.nested(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_linenumber", ["l_partkey"], "items")
    return S.flatten(n, ["l_orderkey"], "items", ["l_linenumber", "l_partkey"]).select("l_orderkey", F.col("pos").cast("long").alias("pos"), "l_partkey")


def _boxes(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("box"), (k * 3 - 88.3).alias("west"), (k * 2 - 20.0).alias("south"), (k * 3 - 85.1).alias("east"), (k * 2 - 17.3).alias("north"))


def s24_tiles(spark, sf):
    return S.tiles(_boxes(spark, sf), [5, 7])


def s08_split(spark, sf):
    b = S.split_box(_boxes(spark, sf))
    return b.select("box", "quarter", *(G.half_up(F.col(c), 6).alias(c) for c in ("west", "south", "east", "north")))


def s22_plan(spark, sf):
    k = F.col("o_orderkey")
    cached, remote = F.when(k % 3 != 0, F.concat(F.lit("v"), k % 4)), F.when(k % 5 != 0, F.concat(F.lit("v"), k % 6))
    return table(spark, sf, "orders").select("o_orderkey", S.plan_load(cached, remote, k % 7 == 0).alias("plan"))


def _ways(spark, sf):
    li = table(spark, sf, "lineitem")
    ways = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("nodes"))
    nodes = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).cast("double").alias("lon"), (F.col("p_partkey") * 91 % 1000).cast("double").alias("lat"))
    return ways, nodes


def r02_way_coords(spark, sf):
    c = S.way_coords(*_ways(spark, sf))
    first, last = F.element_at("ring", 1), F.element_at("ring", -1)
    return c.select("id", F.size("ring").cast("long").alias("n"), first["x"].alias("x0"), last["y"].alias("y1"), "closed")


def s10_extract(spark, sf):
    """Elements: parts as nodes, orders as ways, customers as relations of their orders."""
    ways, nodes = _ways(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    member, tags = "array<struct<type:string,ref:bigint,role:string>>", "map<string,string>"
    w = ways.select(F.lit("way").alias("type"), "id", none("double").alias("lat"), none("double").alias("lon"), "nodes", none(member).alias("members"), F.when(F.col("id") % 10 == 0, F.create_map(F.lit("highway"), F.lit("path"))).alias("tags"))
    n = nodes.select(F.lit("node").alias("type"), "id", "lat", "lon", none("array<bigint>").alias("nodes"), none(member).alias("members"), F.when(F.col("id") % 100 == 1, F.create_map(F.lit("entrance"), F.lit("yes"))).alias("tags"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"), F.lit("outer").alias("role"))).alias("members"))
    r = o.select(F.lit("relation").alias("type"), "id", none("double").alias("lat"), none("double").alias("lon"), none("array<bigint>").alias("nodes"), "members", F.create_map(F.lit("type"), F.lit("multipolygon"), F.when(F.col("id") % 50 == 0, "highway").otherwise("landuse"), F.lit("x")).cast(tags).alias("tags"))
    e = S.extract(n.unionByName(w).unionByName(r), F.map_contains_key("tags", F.lit("highway")), F.map_contains_key("tags", F.lit("entrance")))
    return e.groupBy("type").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


def s05_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return S.last_of(e, "user_id", "event_id", ["event_type", "value"])


def r42_first(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", S.first_not_blank(F.when(k % 3 == 0, F.lit(" ")), F.when(k % 5 == 0, F.lit("config")), F.when(k % 7 != 0, F.lit("key "))).alias("value"))


def j27_cascade(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") * 7 % 100).alias("b"))
    nodes, edges = M.delete_cascade(s, e, s.where("id % 10 = 3"), "id", ("a", "b"))
    count = lambda df, of: df.agg(F.count("*").alias("n")).select(F.lit(of).alias("of"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges"))


def u02_split(spark, sf):
    hidden = table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey")
    c = table(spark, sf, "customer")
    split = c.join(hidden.withColumn("__h", F.lit(True)), c["c_nationkey"] == F.col("n_nationkey"), "left")
    return split.select("c_custkey", F.when(F.col("__h"), "private").otherwise("public").alias("part"))


def u10_report(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))).alias("os"))
    return o.select("o_custkey", F.size(F.filter("os", lambda x: x["s"] != "F")).cast("long").alias("n_public"))


def w05_frames(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    c = O.consecutive(p, ["p_brand"], "p_partkey", ["p_partkey", "p_size"])
    return c.where(F.abs(F.col("p_size") - F.col("next_p_size")) > 25).select("p_partkey", "next_p_partkey")


def w13_rides(spark, sf):
    """Runs of one event type per user, in which a run of any length is one ride."""
    r = O.islands(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])
    return r.where("n > 1").select("user_id", F.col("first").alias("boards"), F.col("last").alias("leaves"), F.col("n").alias("floors"))


def a13_component_stats(spark, sf):
    """Components over suppliers, with rooms (balance under 0) and buildings (every fifth nation)."""
    k = F.col("s_suppkey")
    nodes = table(spark, sf, "supplier").select(k.alias("node"), (F.col("s_acctbal") < 0).alias("room"), F.col("s_nationkey").alias("b"))
    edges = nodes.select(F.col("node").alias("a"), (F.col("node") + 20).alias("b")).where("a % 7 <> 0")
    edges = edges.join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    c = GR.node_components(nodes.select("node"), edges)
    j = c.join(nodes.withColumnRenamed("b", "nation"), "node")
    return j.groupBy("component").agg(F.count("*").alias("size"), F.count_if("room").alias("rooms"), F.count_distinct(F.when(F.col("nation") % 5 == 0, F.col("nation"))).alias("buildings"))


_B = "SELECT n_nationkey AS k, n_nationkey * 3 - 88.3::DOUBLE AS w, n_nationkey * 2 - 20.0::DOUBLE AS s, n_nationkey * 3 - 85.1::DOUBLE AS e, n_nationkey * 2 - 17.3::DOUBLE AS n FROM nation"
_TX = "CAST(floor(({} + 180) / 360 * pow(2, z)) AS BIGINT)"
_TY = "CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * pow(2, z)) AS BIGINT)"
_H = "floor({} * 1000000 + 0.5) / 1000000"
QUERIES = {f.__name__: f for f in (s14_lines, s16_features, s17_flatten, s24_tiles, s08_split, s22_plan, r02_way_coords, s10_extract, s05_last, r42_first, j27_cascade, u02_split, u10_report, w05_frames, w13_rides, a13_component_stats)}
ORACLE = {
    "s14_lines": """SELECT n_nationkey + 1 AS n, '  {"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || CASE WHEN n_nationkey < 24 THEN ',' ELSE '' END AS line FROM nation UNION ALL SELECT 0, '[' UNION ALL SELECT 26, ']'""",
    "s16_features": """SELECT c_custkey, '{"type":"Feature","properties":{"name":"' || c_name || '"},"geometry":{"type":"Point","coordinates":[' || (c_custkey * 37 % 1000) || ',' || (c_custkey * 91 % 1000) || ']}}' AS feature FROM customer""",
    "s17_flatten": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey FROM lineitem",
    "s24_tiles": f"WITH b AS ({_B}), g AS (SELECT k AS box, z AS zoom, unnest(range({_TX.format('w')}, {_TX.format('e')} + 1)) AS x, {_TY.format('n')} AS y0, {_TY.format('s')} AS y1 FROM b, (VALUES (5), (7)) t(z)) SELECT box, zoom, x, unnest(range(y0, y1 + 1)) AS y FROM g",
    "s08_split": f"WITH b AS ({_B}), q AS (SELECT k AS box, q AS quarter, CASE WHEN q % 2 = 0 THEN w ELSE (w + e) / 2 END AS west, CASE WHEN q < 2 THEN s ELSE (s + n) / 2 END AS south, CASE WHEN q % 2 = 0 THEN (w + e) / 2 ELSE e END AS east, CASE WHEN q < 2 THEN (s + n) / 2 ELSE n END AS north FROM b, (VALUES (0), (1), (2), (3)) t(q)) SELECT box, quarter, {', '.join(_H.format(c) + ' AS ' + c for c in ('west', 'south', 'east', 'north'))} FROM q",
    "s22_plan": "SELECT o_orderkey, CASE WHEN c IS NULL AND NOT f THEN 'fetch' WHEN c IS NULL THEN 'none' WHEN f OR r IS NULL THEN 'stale' WHEN c = r THEN 'cache' ELSE 'fetch' END AS plan FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS c, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 6 END AS r, o_orderkey % 7 = 0 AS f FROM orders)",
    "r02_way_coords": """WITH r AS (SELECT l_orderkey AS id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem), c AS (SELECT id, count(*) >= 4 AND arg_min(p, i) = arg_max(p, i) AS closed FROM r GROUP BY 1)
      SELECT id, count(*) AS n, CAST(arg_min(p, i) * 37 % 1000 AS DOUBLE) AS x0, CAST(arg_max(p, i) * 91 % 1000 AS DOUBLE) AS y1, any_value(closed) AS closed FROM r JOIN c USING (id) WHERE p % 7 <> 0 AND p IN (SELECT p_partkey FROM part) GROUP BY 1""",
    "s10_extract": """WITH w AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), m AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey % 50 = 0), kept AS (SELECT id FROM w WHERE id % 10 = 0 OR id IN (SELECT id FROM m)),
      n AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 100 = 1 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM kept)))), r AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 50 = 0)
      SELECT 'node' AS type, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM n UNION ALL SELECT 'way', count(*), CAST(sum(id) AS BIGINT) FROM kept UNION ALL SELECT 'relation', count(*), CAST(sum(id) AS BIGINT) FROM r""",
    "s05_last": "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "r42_first": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'config' WHEN c_custkey % 7 <> 0 THEN 'key' END AS value FROM customer",
    "j27_cascade": "SELECT 'nodes' AS of, count(*) AS n FROM supplier WHERE s_suppkey % 10 <> 3 UNION ALL SELECT 'edges', count(*) FROM (SELECT l_suppkey AS a, l_suppkey * 7 % 100 AS b FROM lineitem) WHERE a NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3) AND b NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)",
    "u02_split": "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN 'private' ELSE 'public' END AS part FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "u10_report": "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS n_public FROM orders GROUP BY 1",
    "w05_frames": "SELECT p_partkey, n AS next_p_partkey FROM (SELECT p_partkey, p_size, lead(p_partkey) OVER w AS n, lead(p_size) OVER w AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) WHERE abs(p_size - s) > 25",
    "w13_rides": """WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
      SELECT user_id, min(event_id) AS boards, max(event_id) AS leaves, count(*) AS floors FROM r GROUP BY user_id, run HAVING count(*) > 1""",
    "a13_component_stats": """WITH s AS (SELECT s_suppkey AS id, s_acctbal < 0 AS room, s_nationkey AS nation FROM supplier), c AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM s p WHERE p.id = s.id - 20) AND (id - 20) % 7 <> 0 THEN 0 ELSE 1 END AS new FROM s),
      g AS (SELECT *, sum(new) OVER (PARTITION BY id % 20 ORDER BY id) AS run FROM c)
      SELECT min(id) AS component, count(*) AS size, count(*) FILTER (room) AS rooms, count(DISTINCT nation) FILTER (nation % 5 = 0) AS buildings FROM g GROUP BY id % 20, run""",
}
