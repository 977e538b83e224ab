"""One graph of indoor and outdoor ways: the union, step sentences of a route, and new routes around what is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.operators.graph import find_paths, node_components


def unified_nodes(indoor: DataFrame, outdoor: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, floor, type, access, lat, lng, outdoor, joined, sole_door) of both graphs, one row an id.

    indoor: node, floor, type, access; outdoor: node, type, access, lat, lng; edges: a, b, access of the indoor graph.
    A node of both keeps its indoor values and takes the coordinates. A sole door is a joined alt door that no
    joined main door reaches indoors without emergency nodes and edges. Emergency exits are not joined.
    """
    i = indoor.select("node", "floor", F.col("type").alias("__type"), F.col("access").alias("__access"), F.lit(True).alias("__in"))
    o = outdoor.select("node", "type", "access", "lat", "lng", F.lit(True).alias("__out"))
    both = i.join(o, "node", "full_outer")
    access = F.coalesce("__access", F.when(F.col("__in").isNull(), F.col("access")), F.lit("main"))
    inside, there = F.col("__in").isNotNull(), F.col("__out").isNotNull()
    joined = inside & there & (access != "emergency")
    n = both.select("node", "floor", F.coalesce("__type", "type").alias("type"), access.alias("access"), F.when(there, F.col("lat")).alias("lat"), F.when(there, F.col("lng")).alias("lng"), (~inside).alias("outdoor"), joined.alias("joined"))
    open_nodes = n.where("not outdoor and access <> 'emergency'").select("node")
    e = edges.where(F.coalesce(F.col("access") != "emergency", F.lit(True))).select("a", "b")
    for end in ("a", "b"):
        e = e.join(open_nodes.select(F.col("node").alias(end)), end, "left_semi")
    c = node_components(open_nodes, e.select("a", "b"))
    doors = n.where("joined and type = 'entrance'").select("node", "access").join(c, "node")
    reached = doors.where("access = 'main'").select("component").distinct()
    sole = doors.where("access = 'alt'").join(reached, "component", "left_anti").select("node", F.lit(True).alias("sole_door"))
    return n.join(sole, "node", "left").fillna(False, ["sole_door"])


def unified_edges(indoor: DataFrame, outdoor: DataFrame) -> DataFrame:
    """(edge, a, b, length, access, accessible, outdoor): roads are alt, steps not accessible; indoor edges
    (edge, a, b, length, access, accessible) as they are; outdoor: edge, a, b, length, kind, access, accessible."""
    o = outdoor.select("edge", "a", "b", "length", F.coalesce("access", F.when(F.col("kind") == "road", "alt").otherwise("main")).alias("access"), (F.coalesce("accessible", F.lit(True)) & ~F.coalesce(F.col("kind") == "steps", F.lit(False))).alias("accessible"), F.lit(True).alias("outdoor"))
    i = indoor.select("edge", "a", "b", "length", F.coalesce("access", F.lit("main")).alias("access"), F.coalesce("accessible", F.lit(True)).alias("accessible"), F.lit(False).alias("outdoor"))
    return i.unionByName(o)


def route_steps(paths: DataFrame, nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query, step, kind, floor, meters, first, last, title) of each path (query, path, destination).

    nodes: node, floor (null outside), level, type, door (what a door is called), building, floor_label; lengths: a, b,
    length, each pair once in either direction. Stretches between two nodes are outdoor if one of them is, else on
    a floor; those that follow each other on one floor, or outdoors, are one step. A change of floor ends a step and
    has no step of its own; a step `door` stands before the first stretch inside.
    """
    w = W.partitionBy("query").orderBy("at")
    n = paths.select("query", "destination", F.posexplode("path").alias("at", "node")).join(nodes, "node")
    ahead = lambda c: F.lead(c).over(w).alias(f"next_{c}")
    s = n.select("query", "destination", "at", "node", "floor", "level", "type", *(ahead(c) for c in ("node", "floor", "level", "type", "door", "building", "floor_label")))
    s = s.where("next_node is not null")
    pair = lengths.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "length").groupBy("lo", "hi").agg(F.min("length").alias("length"))
    s = s.withColumns({"lo": F.least("node", "next_node"), "hi": F.greatest("node", "next_node")}).join(pair, ["lo", "hi"], "left")
    kind = F.when(F.col("floor").isNull() | F.col("next_floor").isNull(), "outdoor").when(F.col("floor") != F.col("next_floor"), "change").otherwise("walk")
    s = s.withColumn("kind", kind)
    key = F.struct("kind", F.when(F.col("kind") == "walk", F.col("floor")))
    s = s.withColumn("run", F.sum(F.when(key.eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)).over(w))
    last = lambda c: F.max_by(c, "at").alias(c)
    r = s.groupBy("query", "run").agg(F.first("destination").alias("destination"), F.first("kind").alias("kind"), F.min_by("floor", "at").alias("floor"), F.sum("length").alias("meters"), F.min_by("node", "at").alias("first"), F.max_by("next_node", "at").alias("last"), F.min_by("level", "at").alias("level"), F.min_by("type", "at").alias("by"), *map(last, ("next_level", "next_door", "next_building", "next_floor_label")))
    v = W.partitionBy("query").orderBy("run")
    then = lambda c: F.lead(c).over(v)
    r = r.withColumns({"after": then("kind"), "after_by": then("by"), "up": then("next_level") > then("level"), "to": then("next_floor_label"), "before": F.lag("kind").over(v)})
    lift = F.concat(F.lit("Take the "), F.when(F.col("after_by") == "elevator", "elevator").otherwise("stairs"), F.when(F.col("up"), " up").otherwise(" down"), F.lit(" to "), F.col("to"))
    title = (
        F.when(F.col("after").isNull(), F.concat(F.lit("Arrive at "), F.col("destination")))
        .when(F.col("kind") == "outdoor", F.concat(F.lit("Walk to the "), F.col("next_door"), F.lit(" of "), F.col("next_building")))
        .when(F.col("after") == "outdoor", F.concat(F.lit("Leave by the "), F.col("next_door")))
        .when(F.col("after") == "change", lift)
    )
    r = r.withColumn("title", title)
    arrived = (F.col("kind") == "outdoor") & F.col("after").isNotNull()
    door = F.struct(F.lit("door").alias("kind"), F.lit(None).cast("double").alias("meters"), F.col("last").alias("first"), F.col("last").alias("last"), F.concat(F.lit("Enter by the "), F.col("next_door")).alias("title"))
    own = F.struct("kind", "meters", "first", "last", "title")
    parts = F.when(arrived, F.array(own, door)).when((F.col("kind") == "change") & F.col("after").isNotNull(), F.array().cast("array<struct<kind:string,meters:double,first:bigint,last:bigint,title:string>>")).otherwise(F.array(own))
    out = r.select("query", "run", "floor", F.posexplode(parts).alias("k", "p"))
    return out.select("query", F.row_number().over(W.partitionBy("query").orderBy("run", "k")).alias("step"), "p.kind", F.when(F.col("p.kind") == "walk", F.col("floor")).alias("floor"), "p.meters", "p.first", "p.last", "p.title")


def route_sentences(steps: DataFrame) -> DataFrame:
    """(query, sentence): a route's steps as one sentence; meters are rounded half up."""
    walk = F.concat(F.lit("walk "), F.floor(F.col("meters") + 0.5).cast("string"), F.lit(" m along the path"))
    low = F.concat(F.lower(F.left("title", F.lit(1))), F.substr("title", F.lit(2)))
    ends = F.col("title").startswith("Arrive at ")
    part = F.when(F.col("kind") == "outdoor", F.when(ends, F.concat(walk, F.lit(", "), low)).otherwise(walk)).otherwise(low)
    said = steps.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", part.alias("part")))), lambda s: s["part"]), ", ").alias("s"))
    return said.select("query", F.concat(F.upper(F.left("s", F.lit(1))), F.substr("s", F.lit(2)), F.lit(".")).alias("sentence"))


def blocked_stretch(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, a, b): the edges of a path from its place `at` on to the next junction (degree of 3 or more) or its end."""
    n = paths.select("query", F.col("at").alias("from"), F.posexplode("path").alias("at", "node")).join(nodes.select("node", "degree"), "node").where(F.col("at") >= F.col("from"))
    w = W.partitionBy("query").orderBy("at")
    met = F.sum(F.when((F.col("at") > F.col("from")) & (F.col("degree") >= 3), 1).otherwise(0)).over(w)
    s = n.withColumns({"met": met, "b": F.lead("node").over(w)})
    return s.where("met = 0 and b is not null").select("query", F.col("node").alias("a"), "b")


def reroute(edges: DataFrame, paths: DataFrame, goals: DataFrame, nodes: DataFrame, locked: DataFrame | None = None, blocked: bool = False) -> DataFrame:
    """New routes (query, goal, cost, path) for walkers at place `at` of their paths (query, path, at).

    locked: (query, node) doors that are closed to a query; the walker who is at one starts from the node before it.
    blocked: the stretch ahead, up to the next junction, is closed. Without both it is the route from here. A query
    that no way is left for has no row. edges as of route_edges.
    """
    here = paths.select("query", "path", "at", F.get("path", F.col("at")).alias("node"))
    avoid = None
    if blocked:
        cut = blocked_stretch(paths, nodes)
        avoid = cut.select("query", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(cut.select("query", F.col("b").alias("src"), F.col("a").alias("dst")))
    if locked is not None:
        at_door = here.join(locked.select("query", "node", F.lit(True).alias("__door")), ["query", "node"], "left")
        here = at_door.withColumn("node", F.when(F.col("__door"), F.get("path", F.greatest(F.col("at") - 1, F.lit(0)))).otherwise(F.col("node")))
        shut = locked.select("query", "node").join(edges.select("src", "dst"), F.col("node") == F.col("dst")).select("query", "src", "dst")
        avoid = shut if avoid is None else avoid.unionByName(shut)
    starts = here.select("query", "node", F.lit(0.0).alias("offset"))
    return find_paths(edges, starts, goals, avoid=avoid)
