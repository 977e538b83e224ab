"""Queries of merge and set operators; the change set is derived from customer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.operators import merge as M
from terrazzo.session import table

COLUMNS = ["c_name", "c_mktsegment", "c_nationkey"]
ALLOWED = ("main", "alt", "emergency")


def base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", *COLUMNS, F.col("c_custkey").alias("ord"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of every 17th key (twice for every 51st), deletes of every 23rd, after them new records for every
    46th, new keys from 10^6 and orphans from 2 * 10^6."""
    k = table(spark, sf, "customer").select("c_custkey")
    m = lambda **f: F.create_map(*(x for n, v in f.items() for x in (F.lit(n), v)))
    key = F.col("c_custkey")
    name = lambda p: F.concat(F.lit(p), key.cast("string"))
    parts = [
        k.where("c_custkey % 17 = 0").select(key, (key * 10).alias("ord"), F.lit("edit").alias("op"), m(c_name=name("edited "), bogus=F.lit("x")).alias("fields")),
        k.where("c_custkey % 51 = 0").select(key, (key * 10 + 1).alias("ord"), F.lit("edit").alias("op"), m(c_mktsegment=F.lit(None).cast("string")).alias("fields")),
        k.where("c_custkey % 23 = 0").select(key, (key * 10 + 2).alias("ord"), F.lit("delete").alias("op"), F.map_filter(m(c_name=F.lit("")), lambda k, v: F.lit(False)).alias("fields")),
        k.where("c_custkey % 46 = 0").select(key, (key * 10 + 3).alias("ord"), F.lit("new").alias("op"), m(c_name=name("again ")).alias("fields")),
        k.where("c_custkey % 29 = 0").select((key + 1_000_000).alias("c_custkey"), (key * 10 + 4).alias("ord"), F.lit("new").alias("op"), m(c_name=name("new "), c_nationkey=F.lit("7")).alias("fields")),
        k.where("c_custkey % 31 = 0").select((key + 2_000_000).alias("c_custkey"), (key * 10 + 5).alias("ord"), F.when(key % 2 == 0, "edit").otherwise("delete").alias("op"), m(c_name=F.lit("lost")).alias("fields")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def j01_override_merge(spark, sf):
    return M.apply_overrides(base(spark, sf), changes(spark, sf), "c_custkey", COLUMNS)


def j01_merge_report(spark, sf):
    return M.merge_report(base(spark, sf), changes(spark, sf), "c_custkey", COLUMNS)


def j02_diff(spark, sf):
    b = base(spark, sf)
    d = M.diff_overrides(b, M.apply_overrides(b, changes(spark, sf), "c_custkey", COLUMNS), "c_custkey", COLUMNS)
    return d.select("c_custkey", "op", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("changed"))


def j03_orphans(spark, sf):
    return M.orphan_records(base(spark, sf), changes(spark, sf), "c_custkey", COLUMNS).select("c_custkey", "ord", "op")


def p28_ignored(spark, sf):
    return M.ignored_fields(changes(spark, sf), "c_custkey", COLUMNS)


def u01_last_wins(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 7).alias("v"))
    other = c.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("other"))
    return M.last_wins([c.unionByName(c.withColumn("v", F.col("v") + 1)), other], ["c_custkey"], "v").select("c_custkey", "c_name", "v")


def u03_insert(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return M.insert_missing(e.where("event_id % 50 = 0"), e.where("event_id % 50 <> 0"), ["user_id", "event_type"], "event_id")


def u09_set_one(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey", F.lit("main").alias("access"))
    edit = p.where("s_suppkey % 4 = 0").withColumn("access", F.when(F.col("s_suppkey") % 8 == 0, "alt"))
    return M.set_one(p, edit, "s_suppkey", "access")


def _paths(spark, sf):
    s = table(spark, sf, "supplier")
    edges = s.select(F.col("s_suppkey").alias("way"), F.lit("main").alias("access"))
    entries = s.where("s_suppkey % 5 = 0").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 10 == 0, 0).otherwise(10**6)).alias("way"), F.when(F.col("s_suppkey") % 20 == 0, "odd").otherwise("alt").alias("access"))
    return edges, entries


def j12_reclassify(spark, sf):
    return M.reclassify(*_paths(spark, sf), "way", "access", ALLOWED)


def j12_report(spark, sf):
    return M.reclassify_report(*_paths(spark, sf), "way", "access", ALLOWED)


def j18_effective(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("ord"))
    edits = p.where("p_partkey % 9 = 0").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(10**6)).alias("p_partkey"), F.lit("edited").alias("p_name"), "ord", (F.col("p_partkey") % 4 == 0).alias("drop"))
    return M.effective(p, edits, "p_partkey")


def p02_public_cascade(spark, sf):
    """Region 1 is hidden: its nations go, with their customers and suppliers, and lineitems of such suppliers."""
    nation, supplier, lineitem = (table(spark, sf, t) for t in ("nation", "supplier", "lineitem"))
    hidden = nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    gone = supplier.join(hidden, "s_nationkey", "left_semi").select("s_suppkey")
    edges = lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % F.lit(50)).alias("b"))
    nodes, kept = M.delete_cascade(supplier, edges, gone, "s_suppkey", ("a", "b"))
    n = nodes.agg(F.count("*").alias("n_nodes"))
    return kept.agg(F.count("*").alias("n_edges"), F.sum(F.col("a") + F.col("b")).alias("total")).join(F.broadcast(n))


def f35_next(spark, sf):
    ids = table(spark, sf, "supplier").select(F.concat(F.lit("path-"), F.col("s_suppkey").cast("string")).alias("id"))
    return M.next_suffix(ids, "id", "path-")


def w11_stable_ids(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("ord"))
    previous = e.where("ord % 4 = 1").withColumn("id", F.col("ord") * 2)
    return M.stable_ids(e, previous, ["user_id", "event_type"], "ord").select("ord", "id")


_CH = """
b AS (SELECT c_custkey AS k, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer),
n AS (SELECT k, k AS ord,
  CASE WHEN k % 46 = 0 THEN 'again ' || k WHEN k % 17 = 0 THEN 'edited ' || k ELSE c_name END AS c_name,
  CASE WHEN k % 46 = 0 THEN '' WHEN k % 51 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN k % 46 = 0 THEN '' ELSE c_nationkey END AS c_nationkey FROM b WHERE k % 23 <> 0 OR k % 46 = 0
  UNION ALL SELECT k + 1000000, 1099511627776 + k * 10 + 4, 'new ' || k, '', '7' FROM b WHERE k % 29 = 0)"""
QUERIES = {f.__name__: f for f in (j01_override_merge, j01_merge_report, j02_diff, j03_orphans, p28_ignored, u01_last_wins, u03_insert, u09_set_one, j12_reclassify, j12_report, j18_effective, p02_public_cascade, f35_next, w11_stable_ids)}
ORACLE = {
    "j01_override_merge": f"WITH {_CH} SELECT k AS c_custkey, c_name, c_mktsegment, c_nationkey, ord FROM n",
    "j01_merge_report": """SELECT count(*) FILTER (k % 17 = 0) + count(*) FILTER (k % 51 = 0) AS edited, count(*) FILTER (k % 46 = 0) + count(*) FILTER (k % 29 = 0) AS added,
      count(*) FILTER (k % 23 = 0) AS deleted, count(*) FILTER (k % 31 = 0) AS orphans,
      CAST(sum(greatest(0, (k % 17 = 0)::INT + (k % 51 = 0)::INT + (k % 23 = 0)::INT + (k % 46 = 0)::INT - 1)) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS new_in_base FROM (SELECT c_custkey AS k FROM customer)""",
    "j02_diff": f"""WITH {_CH} SELECT coalesce(b.k, n.k) AS c_custkey, CASE WHEN n.k IS NULL THEN 'delete' WHEN b.k IS NULL THEN 'new' ELSE 'edit' END AS op,
      CASE WHEN n.k IS NULL THEN '' WHEN b.k IS NULL THEN 'c_mktsegment,c_name,c_nationkey' ELSE concat_ws(',', CASE WHEN coalesce(b.c_mktsegment, '') <> coalesce(n.c_mktsegment, '') THEN 'c_mktsegment' END, CASE WHEN b.c_name <> n.c_name THEN 'c_name' END, CASE WHEN b.c_nationkey <> n.c_nationkey THEN 'c_nationkey' END) END AS changed
      FROM b FULL JOIN n ON b.k = n.k WHERE b.k IS NULL OR n.k IS NULL OR coalesce(b.c_mktsegment, '') <> coalesce(n.c_mktsegment, '') OR b.c_name <> n.c_name OR b.c_nationkey <> n.c_nationkey""",
    "j03_orphans": "SELECT c_custkey + 2000000 AS c_custkey, c_custkey * 10 + 5 AS ord, CASE WHEN c_custkey % 2 = 0 THEN 'edit' ELSE 'delete' END AS op FROM customer WHERE c_custkey % 31 = 0",
    "p28_ignored": "SELECT c_custkey, 'bogus' AS field FROM customer WHERE c_custkey % 17 = 0",
    "u01_last_wins": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE c_name END AS c_name, c_custkey % 7 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS v FROM customer",
    "u03_insert": """WITH a AS (SELECT user_id, event_type, event_id FROM events WHERE event_id % 50 = 0)
      SELECT * FROM a UNION ALL SELECT user_id, event_type, min(event_id) FROM events e WHERE event_id % 50 <> 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = e.user_id AND a.event_type = e.event_type) GROUP BY 1, 2""",
    "u09_set_one": "SELECT s_suppkey, CASE WHEN s_suppkey % 8 = 0 THEN 'alt' ELSE 'main' END AS access FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 8 = 0",
    "j12_reclassify": "SELECT s_suppkey AS way, CASE WHEN s_suppkey % 10 = 0 AND s_suppkey % 20 <> 0 THEN 'alt' ELSE 'main' END AS access FROM supplier",
    "j12_report": "SELECT s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 1000000 END AS way, CASE WHEN s_suppkey % 20 = 0 THEN 'odd' ELSE 'alt' END AS access, CASE WHEN s_suppkey % 20 = 0 THEN 'invalid' WHEN s_suppkey % 10 <> 0 THEN 'unknown' ELSE 'applied' END AS status FROM supplier WHERE s_suppkey % 5 = 0",
    "j18_effective": """SELECT p_partkey, CASE WHEN p_partkey % 18 = 0 THEN 'edited' ELSE p_name END AS p_name, p_partkey AS ord FROM part WHERE NOT (p_partkey % 36 = 0)
      UNION ALL SELECT p_partkey + 1000000, 'edited', 1099511627776 + p_partkey FROM part WHERE p_partkey % 9 = 0 AND p_partkey % 2 = 1""",
    "p02_public_cascade": """WITH g AS (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1),
      e AS (SELECT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % 50 AS b FROM lineitem)
      SELECT count(*) AS n_edges, CAST(sum(a + b) AS BIGINT) AS total, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM g)) AS n_nodes FROM e WHERE a NOT IN (SELECT s_suppkey FROM g) AND b NOT IN (SELECT s_suppkey FROM g)""",
    "f35_next": "SELECT max(s_suppkey) + 1 AS next FROM supplier",
    "w11_stable_ids": """WITH r AS (SELECT event_id AS ord, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
      p AS (SELECT user_id, event_type, event_id * 2 AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 4 = 1),
      m AS (SELECT r.ord, p.id FROM r LEFT JOIN p USING (user_id, event_type, n))
      SELECT ord, id FROM m WHERE id IS NOT NULL UNION ALL SELECT ord, row_number() OVER (ORDER BY ord) + (SELECT max(id) FROM p) FROM m WHERE id IS NULL""",
}
