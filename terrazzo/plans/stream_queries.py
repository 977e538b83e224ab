"""Queries of the position state machine and event rules, over events as fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazzo.functions.geo import half_up
from terrazzo.session import table
from terrazzo.streaming import fixes as S

BOX = (100.0, 100.0, 600.0, 600.0)


def fixes(spark, sf):
    """Events as fixes: coordinates and codes from the event's id, a device heading for every fifth."""
    k = F.col("event_id")
    code = F.when(k % 41 == 0, 1).when(k % 13 == 0, 2)
    x = F.when(k % 29 != 0, (k * 37 % 1200).cast("double"))
    return table(spark, sf, "events").select("user_id", k.alias("ord"), x.alias("x"), (k * 91 % 1100).cast("double").alias("y"), F.when(k % 5 == 0, (k % 360).cast("double")).alias("heading"), F.when(k % 10 == 0, 0.1).alias("speed"), code.cast("int").alias("code"))


def e01_fixes(spark, sf):
    f = S.fold(fixes(spark, sf), BOX)
    return f.select("user_id", "ord", half_up(F.col("heading"), 3).alias("heading"), "state", "moved")


def e02_states(spark, sf):
    k = F.col("event_id")
    s = S.state_of((k * 37 % 1200).cast("double"), (k * 91 % 1100).cast("double"), BOX, k % 6 == 0)
    e = table(spark, sf, "events").select("event_id", s.alias("state"))
    return e.select("event_id", "state", S.snaps((k % 30).cast("double"), (k % 17).cast("double"), F.col("state")).alias("snapped"))


def e04_reroutes(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_id") * 7 % 23).cast("double").alias("distance"))
    return S.off_route(e).select("ord", "reroute")


def e05_queue(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("name"), (F.col("event_id") % 97 == 0).alias("ready"))
    return S.queued(e, F.col("ready"), ("click", "view"), 5).select("user_id", "ord", "name")


def e06_runs(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("t"))
    r = S.coalesced_runs(e, 600.0, "user_id", "t")
    return r.select("user_id", F.col("at").cast("long").alias("at"), "n")


def e07_dispatch(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    out = None
    for name, rows in S.dispatched(e, ("click", "purchase")).items():
        rows = rows.select("event_id", F.lit(name).alias("handler"))
        out = rows if out is None else out.unionByName(rows)
    return out


def e08_links(spark, sf):
    k = F.col("page_id")
    m = F.create_map(F.lit("qr"), F.when(k % 5 == 0, "q").otherwise(""), F.lit("loc"), F.when(k % 3 == 0, F.col("url")), F.lit("room"), F.when(k % 2 == 0, F.concat(F.lit("r"), k)), F.lit("sched"), F.when(k % 7 == 0, "s1"))
    return table(spark, sf, "pages").select("page_id", S.deep_link(m).alias("d")).select("page_id", "d.action", "d.value", "d.schedule")


def r32_messages(spark, sf):
    e = e02_states(spark, sf)
    return e.groupBy(S.message(F.col("state"), F.lit("B1")).alias("said")).agg(F.count("*").alias("n"))


_FIX = "SELECT user_id, event_id AS k, CASE WHEN event_id % 41 = 0 THEN 1 WHEN event_id % 13 = 0 THEN 2 END AS code, CASE WHEN event_id % 29 <> 0 THEN CAST(event_id * 37 % 1200 AS DOUBLE) END AS x, CAST(event_id * 91 % 1100 AS DOUBLE) AS y, CASE WHEN event_id % 5 = 0 AND event_id % 10 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS own FROM events"
_AWAY = "sqrt(pow(greatest(100 - {x}, 0, {x} - 600), 2) + pow(greatest(100 - {y}, 0, {y} - 600), 2)) > 400"
QUERIES = {f.__name__: f for f in (e01_fixes, e02_states, e04_reroutes, e05_queue, e06_runs, e07_dispatch, e08_links, r32_messages)}
ORACLE = {
    # the machine one fix a step, all users at once
    "e01_fixes": f"""WITH RECURSIVE f AS (SELECT *, code IS NULL AND x IS NOT NULL AS pos, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n, CASE WHEN {_AWAY.format(x='x', y='y')} THEN 'offcampus' ELSE 'on' END AS s FROM ({_FIX})),
      m(user_id, k, n, px, py, heading, fix, state, moved) AS (
        SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, 'locating', false FROM f
        UNION ALL
        SELECT user_id, k, n, CASE WHEN go THEN x ELSE px END, CASE WHEN go THEN y ELSE py END,
          CASE WHEN pos THEN coalesce(own, CASE WHEN px IS NOT NULL AND go THEN (degrees(atan2(x - px, y - py)) + 360) % 360 END, heading) WHEN code = 1 THEN NULL ELSE heading END,
          pos OR (fix AND coalesce(code, 0) <> 1), CASE WHEN pos THEN s WHEN code = 1 THEN 'denied' WHEN code IS NOT NULL AND NOT fix THEN 'unavailable' ELSE state END, go
        FROM (SELECT f.*, m.px, m.py, m.heading, m.fix, m.state, f.pos AND (m.px IS NULL OR sqrt(pow(f.x - m.px, 2) + pow(f.y - m.py, 2)) > 4) AS go FROM m JOIN f ON f.user_id = m.user_id AND f.n = m.n + 1))
      SELECT user_id, k AS ord, floor(heading * 1000 + 0.5) / 1000 AS heading, state, moved FROM m WHERE n > 0""",
    "e02_states": f"SELECT event_id, state, state = 'on' AND event_id % 30 <= least(25, greatest(8, CASE WHEN event_id % 17 = 0 THEN 50 ELSE event_id % 17 END)) AS snapped FROM (SELECT event_id, CASE WHEN {_AWAY.format(x='event_id * 37 % 1200', y='event_id * 91 % 1100')} THEN 'offcampus' WHEN event_id % 6 = 0 THEN 'indoors' ELSE 'on' END AS state FROM events)",
    "e04_reroutes": "SELECT event_id AS ord, event_id * 7 % 23 > 15 AND NOT coalesce(lag(event_id * 7 % 23 > 15) OVER (PARTITION BY user_id ORDER BY event_id), false) AS reroute FROM events",
    "e05_queue": """WITH e AS (SELECT *, event_id >= coalesce(min(event_id) FILTER (event_id % 97 = 0) OVER (PARTITION BY user_id), 1000000000000) AS ready FROM events WHERE event_type IN ('click', 'view'))
      SELECT user_id, event_id AS ord, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ready ORDER BY event_id) AS n FROM e) WHERE ready OR n <= 5""",
    "e06_runs": """WITH RECURSIVE t AS (SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS t FROM events),
      r(user_id, run_at) AS (SELECT user_id, min(t) FROM t GROUP BY 1 UNION ALL SELECT user_id, run_at FROM (SELECT r.user_id, greatest(min(t.t), r.run_at + 600) AS run_at FROM r JOIN t ON t.user_id = r.user_id AND t.t > r.run_at GROUP BY r.user_id, r.run_at)),
      w AS (SELECT user_id, run_at, lag(run_at) OVER (PARTITION BY user_id ORDER BY run_at) AS prev FROM r)
      SELECT w.user_id, run_at AS "at", count(*) AS n FROM w JOIN t ON t.user_id = w.user_id AND t.t <= run_at AND t.t > coalesce(prev, -1) GROUP BY ALL""",
    "e07_dispatch": "SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'unknown' END AS handler FROM events",
    "e08_links": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'payload' WHEN page_id % 3 = 0 THEN 'place' WHEN page_id % 2 = 0 THEN 'room' END AS action, CASE WHEN page_id % 5 = 0 THEN 'q' WHEN page_id % 3 = 0 THEN url WHEN page_id % 2 = 0 THEN 'r' || page_id END AS value, CASE WHEN page_id % 7 = 0 THEN 's1' END AS schedule FROM pages",
    "r32_messages": f"SELECT CASE state WHEN 'offcampus' THEN 'You are not on campus yet.' WHEN 'indoors' THEN 'You seem to be inside B1. GPS is not precise indoors: scan a nearby campus QR code to set where you are.' END AS said, count(*) AS n FROM (SELECT CASE WHEN {_AWAY.format(x='event_id * 37 % 1200', y='event_id * 91 % 1100')} THEN 'offcampus' WHEN event_id % 6 = 0 THEN 'indoors' ELSE 'on' END AS state FROM events) GROUP BY 1",
}
