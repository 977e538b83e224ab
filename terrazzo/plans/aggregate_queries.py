"""Queries of aggregates and ordered operators over orders, lineitem, events, conversations, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.operators import aggregate as A
from terrazzo.operators import ordered as O
from terrazzo.session import table

_R = "CAST(floor({} * 10000 + 0.5) AS DOUBLE) / 10000"


def r4(c):
    return F.floor(c * 10000 + 0.5).cast("double") / 10000


def a01_a02_counts(spark, sf):
    o = table(spark, sf, "orders")
    one = o.groupBy(F.col("o_orderstatus").alias("k")).count().select(F.lit("status").alias("of"), "k", F.col("count").alias("n"))
    two = o.groupBy(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("k")).count().select(F.lit("both").alias("of"), "k", F.col("count").alias("n"))
    return one.unionByName(two)


def a03_payload(spark, sf):
    return A.counts_of({t: table(spark, sf, t) for t in ("region", "nation")})


def a05_access_counts(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(*(F.count_if(F.col("user_id") % 3 == i).alias(k) for i, k in enumerate(("main", "alt", "emergency"))))


def a06_types(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand", "p_type").count()
    return p.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_type", "count"))))).alias("counts"))


def a07_median(spark, sf):
    return A.exact_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", 0.5, "median")


def a08_mode(spark, sf):
    return A.mode_first(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


def a09_residuals(spark, sf):
    e = A.residuals(["user_id"], "value", table(spark, sf, "events"))
    return e.select("user_id", *(r4(F.col(c)).alias(c) for c in ("rms", "mean", "p90", "max")))


def _edges(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_suppkey")).alias("a"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % F.lit(100)).alias("b"), F.col("l_returnflag").alias("kind"))


def a10_evidence(spark, sf):
    halls = table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("node"))
    return A.passage_evidence(_edges(spark, sf), halls, "a", "b", "kind", ["A", "N", "R"])


def a11_degree(spark, sf):
    return A.degree(_edges(spark, sf), "a", "b")


def a12_envelope(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") * 37 % 1000).alias("x"), (F.col("c_custkey") * 91 % 1000).alias("y"))
    return c.groupBy("c_nationkey").agg(*A.envelope("x", "y"))


def a14_best(spark, sf):
    n = table(spark, sf, "customer").select((F.col("c_custkey") % 13).alias("comp"), (F.col("c_acctbal") > 5000).alias("flag"))
    return A.best_component(n, "comp", "flag")


def a17_agreement(spark, sf):
    o = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("a"), F.col("l_partkey"), "l_returnflag")
    ok = A.agrees(F.col("a"), F.lit(2000.0))
    g = o.groupBy("l_returnflag").agg(*A.agreement(ok))
    return g.withColumn("share", r4(F.col("share")))


def a18_version(spark, sf):
    return A.content_version(table(spark, sf, "nation"), ["n_nationkey"], block=10)


def s21_listing(spark, sf):
    return A.listing_hash(table(spark, sf, "pages").select("page_id", "html"), "page_id", "html")


def w01_w10_ordinals(spark, sf):
    e = table(spark, sf, "events")
    out = O.ordinal(e, ["user_id", "event_type"], [F.col("value").desc(), "event_id"], "by_value")
    return O.ordinal(out, ["user_id"], ["event_id"], "by_file").select("event_id", "by_value", "by_file")


def w03_chain(spark, sf):
    c = table(spark, sf, "conversations")
    return O.chain_edges(c, ["conv_id"], "turn", "turn", F.length("text") % 4 != 0)


def w04_lead(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    c = O.consecutive(li, ["l_orderkey"], "l_linenumber", ["l_linenumber", "l_partkey"])
    return c.select("l_orderkey", "l_linenumber", "next_l_partkey", ((F.col("next_l_linenumber") - F.col("l_linenumber")) * 12).cast("long").alias("cost"))


def w06_ring(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.hour(F.col("ts").cast("timestamp")).alias("h"), "value")
    return O.cyclic_runs(e, ["user_id"], "h", 24, F.col("value") > 10).select("user_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))


def w07_chain(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.floor(F.col("value")).cast("double").alias("v"))
    return O.longest_chain(e, ["user_id"], "v", 2.0, 5.0).select("user_id", F.col("n").cast("long").alias("n"))


def w08_marker(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t"))
    return O.next_marker(e, "t", F.lit("2024-01-15 06:30:00").cast("timestamp")).select("event_id", "state")


def w09_first(spark, sf):
    return O.first_of(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", ["event_id", "value"])


def w12_legs(spark, sf):
    return O.islands(table(spark, sf, "events"), ["user_id"], "event_id", ["event_type"]).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "first", "last", "n")


def _scored(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") + 1000).alias("score"), (F.col("c_custkey") * 37 % 100).cast("double").alias("x"), (F.col("c_custkey") * 91 % 100).cast("double").alias("y"), (F.col("c_custkey") * 13 % 360).cast("double").alias("face"))


def t03_order(spark, sf):
    return O.ordinal(_scored(spark, sf), ["c_nationkey"], [F.col("score").desc(), "c_custkey"], "place").where("place <= 5").select("c_nationkey", "c_custkey", "place")


def t04_choice(spark, sf):
    return O.greedy_choice(_scored(spark, sf), ["c_nationkey"], "c_custkey", "score", "x", "y", face="face")


def u06_radius(spark, sf):
    return O.radius_dedupe(_scored(spark, sf), ["c_nationkey"], "c_custkey", "x", "y", 30.0)


def t08_children(spark, sf):
    n = O.sorted_children(table(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", ["n_name"], "floors")
    return n.select("n_regionkey", F.to_json("floors").alias("floors"))


def t11_apart(spark, sf):
    s = _scored(spark, sf).select("c_nationkey", "score", F.col("face").cast("int").alias("deg"))
    return O.apart(s.groupBy("c_nationkey", "deg").agg(F.min("score").alias("score")), ["c_nationkey"], "score", "deg")


def t12_trimmed(spark, sf):
    t = O.trimmed(table(spark, sf, "events").select("user_id", "value", "event_id"), ["user_id"], "value")
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def u04_pairs(spark, sf):
    e = _edges(spark, sf).groupBy("a", "b").agg(F.count("*").alias("w")).select("a", "b", (F.col("a") * 1000 + F.col("b")).alias("ord"))
    return O.unordered_pairs(e, "a", "b", "ord")


def u05_segments(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5 + 0.01).alias("x1"), (F.col("c_custkey") % 3).cast("double").alias("y1"), (F.col("c_custkey") % 4).cast("double").alias("x2"), (F.col("c_custkey") % 2 + 0.02).alias("y2"))
    return O.segment_dedupe(c, ["x1", "y1", "x2", "y2"], "c_custkey").select("c_custkey")


_E100 = "e AS (SELECT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % 100 AS b, l_returnflag AS kind FROM lineitem), s AS (SELECT a AS node, b AS other, kind FROM e UNION ALL SELECT b, a, kind FROM e)"
_SCORED = "SELECT c_nationkey AS g, c_custkey AS id, CAST(floor(c_acctbal + 1000) AS BIGINT) AS score, CAST(c_custkey * 37 % 100 AS DOUBLE) AS x, CAST(c_custkey * 91 % 100 AS DOUBLE) AS y, CAST(c_custkey * 13 % 360 AS DOUBLE) AS face FROM customer"
QUERIES = {f.__name__: f for f in (a01_a02_counts, a03_payload, a05_access_counts, a06_types, a07_median, a08_mode, a09_residuals, a10_evidence, a11_degree, a12_envelope, a14_best, a17_agreement, a18_version, s21_listing, w01_w10_ordinals, w03_chain, w04_lead, w06_ring, w07_chain, w08_marker, w09_first, w12_legs, t03_order, t04_choice, u06_radius, t08_children, t11_apart, t12_trimmed, u04_pairs, u05_segments)}
ORACLE = {
    "a01_a02_counts": "SELECT 'status' AS of, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'both', o_orderstatus || '/' || o_orderpriority, count(*) FROM orders GROUP BY ALL",
    "a03_payload": """SELECT 'region' AS name, count(*) AS n, CAST(sum(length('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}')) AS BIGINT) AS bytes FROM region
      UNION ALL SELECT 'nation', count(*), CAST(sum(length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}')) AS BIGINT) FROM nation""",
    "a05_access_counts": "SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS main, count(*) FILTER (user_id % 3 = 1) AS alt, count(*) FILTER (user_id % 3 = 2) AS emergency FROM events GROUP BY 1",
    "a06_types": """SELECT p_brand, '{' || string_agg('"' || p_type || '":' || n, ',' ORDER BY p_type) || '}' AS counts FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1""",
    "a07_median": "SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1",
    "a08_mode": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1",
    "a09_residuals": f"SELECT user_id, {_R.format('sqrt(avg(value * value))')} AS rms, {_R.format('avg(value)')} AS mean, {_R.format('list_sort(list(value))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1]')} AS p90, {_R.format('max(value)')} AS max FROM events GROUP BY 1",
    "a10_evidence": f"WITH {_E100} SELECT node, count(DISTINCT other) AS neighbors, count(DISTINCT other) FILTER (other % 5 = 0 AND other IN (SELECT s_suppkey FROM supplier)) AS hallways, count(*) FILTER (kind = 'A') AS A, count(*) FILTER (kind = 'N') AS N, count(*) FILTER (kind = 'R') AS R FROM s GROUP BY 1",
    "a11_degree": f"WITH {_E100} SELECT node, count(*) AS degree FROM s GROUP BY 1",
    "a12_envelope": "SELECT c_nationkey, min(c_custkey * 37 % 1000) AS min_x, min(c_custkey * 91 % 1000) AS min_y, max(c_custkey * 37 % 1000) AS max_x, max(c_custkey * 91 % 1000) AS max_y FROM customer GROUP BY 1",
    "a14_best": "SELECT c_custkey % 13 AS comp, count(*) FILTER (c_acctbal > 5000) AS flagged, count(*) AS size FROM customer GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1",
    "a17_agreement": f"SELECT l_returnflag, count(*) FILTER (abs(l_extendedprice / l_quantity - 2000) <= 60) AS matched, count(*) AS total, {_R.format('CAST(count(*) FILTER (abs(l_extendedprice / l_quantity - 2000) <= 60) AS DOUBLE) / count(*)')} AS share FROM lineitem GROUP BY 1",
    "a18_version": """SELECT left(sha256(string_agg(d, '' ORDER BY b)), 12) AS version FROM (SELECT n_nationkey // 10 AS b, sha256(string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}', chr(10) ORDER BY n_nationkey)) AS d FROM nation GROUP BY 1)""",
    "s21_listing": "SELECT page_id, left(sha256(html), 12) AS revision FROM pages",
    "w01_w10_ordinals": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS by_value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS by_file FROM events",
    "w03_chain": "SELECT conv_id, turn, a, turn AS b FROM (SELECT conv_id, turn, length(text) % 4 <> 0 AS ok, lag(turn) OVER w AS a, lag(length(text) % 4 <> 0) OVER w AS was FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE ok AND was",
    "w04_lead": "SELECT l_orderkey, l_linenumber, np AS next_l_partkey, CAST((nl - l_linenumber) * 12 AS BIGINT) AS cost FROM (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER w AS nl, lead(p) OVER w AS np FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) WHERE nl IS NOT NULL",
    "w06_ring": """WITH f AS (SELECT DISTINCT user_id, hour(ts) AS h FROM events WHERE value > 10), n AS (SELECT user_id, count(*) AS c FROM f GROUP BY 1),
      g AS (SELECT user_id, h + 24 * k AS h FROM f, (VALUES (0), (1)) t(k)), i AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS r FROM g),
      runs AS (SELECT user_id, min(h) AS s, count(*) AS n FROM i GROUP BY user_id, r)
      SELECT user_id, s AS start, n FROM runs JOIN n USING (user_id) WHERE c < 24 AND s < 24 AND NOT (s = 0 AND EXISTS (SELECT 1 FROM f WHERE f.user_id = runs.user_id AND f.h = 23))
      UNION ALL SELECT user_id, 0, 24 FROM n WHERE c = 24""",
    "w07_chain": """WITH RECURSIVE v AS (SELECT DISTINCT user_id, CAST(floor(value) AS DOUBLE) AS v FROM events),
      c AS (SELECT user_id, v, CAST(1 AS BIGINT) AS n FROM v UNION ALL SELECT c.user_id, (SELECT min(v.v) FROM v WHERE v.user_id = c.user_id AND v.v >= c.v + 2 AND v.v <= c.v + 5), n + 1 FROM c WHERE c.v IS NOT NULL)
      SELECT user_id, max(n) AS n FROM c WHERE v IS NOT NULL GROUP BY 1""",
    "w08_marker": "WITH e AS (SELECT event_id, date_trunc('hour', ts) AS t FROM events) SELECT event_id, CASE WHEN t < TIMESTAMP '2024-01-15 06:30:00' THEN 'past' WHEN t = (SELECT min(t) FROM e WHERE t >= TIMESTAMP '2024-01-15 06:30:00') THEN 'next' ELSE 'later' END AS state FROM e",
    "w09_first": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2",
    "w12_legs": "WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM a) SELECT user_id, run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY 1, 2, 3",
    "t03_order": f"SELECT g AS c_nationkey, id AS c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS place FROM ({_SCORED})) WHERE place <= 5",
    "t04_choice": f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS n, max(score) OVER (PARTITION BY g) AS best FROM ({_SCORED})),
      c(g, n, ids, xs, ys, fs) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), []::BIGINT[], []::DOUBLE[], []::DOUBLE[], []::DOUBLE[] FROM s
        UNION ALL SELECT g, n, CASE WHEN take THEN list_append(ids, id) ELSE ids END, CASE WHEN take THEN list_append(xs, x) ELSE xs END, CASE WHEN take THEN list_append(ys, y) ELSE ys END, CASE WHEN take THEN list_append(fs, face) ELSE fs END
        FROM (SELECT s.*, ids, xs, ys, fs, len(ids) < 4 AND NOT (len(ids) >= 2 AND score < 0.75 * best) AND len(list_filter(range(1, len(ids) + 1), lambda i: sqrt((xs[i] - x) ** 2 + (ys[i] - y) ** 2) < 8 OR (sqrt((xs[i] - x) ** 2 + (ys[i] - y) ** 2) < 30 AND abs((fs[i] - face + 540) % 360 - 180) < 60))) = 0 AS take FROM c JOIN s ON s.g = c.g AND s.n = c.n + 1))
      SELECT g AS c_nationkey, place, ids[place] AS c_custkey FROM (SELECT g, ids, unnest(range(1, len(ids) + 1)) AS place FROM (SELECT g, arg_max(ids, n) AS ids FROM c GROUP BY g))""",
    "u06_radius": f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS n FROM ({_SCORED})),
      c(g, n, ids, xs, ys) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), []::BIGINT[], []::DOUBLE[], []::DOUBLE[] FROM s
        UNION ALL SELECT g, n, CASE WHEN take THEN list_append(ids, id) ELSE ids END, CASE WHEN take THEN list_append(xs, x) ELSE xs END, CASE WHEN take THEN list_append(ys, y) ELSE ys END
        FROM (SELECT s.*, ids, xs, ys, len(list_filter(range(1, len(ids) + 1), lambda i: sqrt((xs[i] - x) ** 2 + (ys[i] - y) ** 2) < 30)) = 0 AS take FROM c JOIN s ON s.g = c.g AND s.n = c.n + 1))
      SELECT g AS c_nationkey, unnest(ids) AS c_custkey FROM (SELECT g, arg_max(ids, n) AS ids FROM c GROUP BY g)""",
    "t08_children": """SELECT n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS floors FROM nation GROUP BY 1""",
    "t12_trimmed": "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, user_id, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= floor(n * 0.8) GROUP BY 1",
    "u04_pairs": "WITH e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % 100 AS b FROM lineitem) SELECT a, b, a * 1000 + b AS ord FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY a * 1000 + b) AS r FROM e WHERE a <> b) WHERE r = 1",
    "u05_segments": "SELECT min(c_custkey) AS c_custkey FROM (SELECT c_custkey, [c_custkey % 5, c_custkey % 3] AS p, [c_custkey % 4, c_custkey % 2] AS q FROM customer) GROUP BY least(p, q), greatest(p, q)",
    "t11_apart": f"""WITH RECURSIVE d AS (SELECT g, CAST(face AS INT) AS deg, min(score) AS score FROM ({_SCORED}) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score, deg) AS n FROM d),
      c(g, n, s, f) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), []::BIGINT[], []::INT[] FROM o UNION ALL SELECT g, n, CASE WHEN take THEN list_append(s, score) ELSE s END, CASE WHEN take THEN list_append(f, deg) ELSE f END
      FROM (SELECT o.*, s, f, len(f) < 2 AND len(list_filter(f, lambda z: abs((z - deg + 540) % 360 - 180) < 10)) = 0 AS take FROM c JOIN o ON o.g = c.g AND o.n = c.n + 1))
      SELECT g AS c_nationkey, unnest(s) AS score, unnest(f) AS deg FROM (SELECT g, arg_max(s, n) AS s, arg_max(f, n) AS f FROM c GROUP BY g)""",
}
