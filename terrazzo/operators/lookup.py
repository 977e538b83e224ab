"""Lookups with fallbacks, decorations and cascading matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.functions import geo as G
from terrazzo.functions import text as T
from terrazzo.operators.aggregate import symmetric


def decorate(rows: DataFrame, key: str, names: DataFrame, name_key: str, label: str, default: Column, out: str) -> DataFrame:
    """Rows with a label looked up by key, or the default."""
    n = names.select(F.col(name_key).alias("__k"), F.col(label).alias("__l"))
    return rows.join(n, rows[key] == n["__k"], "left").withColumn(out, F.coalesce("__l", default)).drop("__k", "__l")


def cascade(rows: DataFrame, key: str, ident: str, sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(ident, found): the value of the first source (frame, key, value) that knows the row's key."""
    out, got = rows, []
    for i, (frame, k, v) in enumerate(sources):
        s = frame.groupBy(F.col(k).alias(f"__k{i}")).agg(F.min(v).alias(f"__v{i}"))
        out = out.join(s, F.col(key) == F.col(f"__k{i}"), "left")
        got.append(F.col(f"__v{i}"))
    return out.select(ident, F.coalesce(*got).alias("found"))


def find_rooms(asked: DataFrame, rooms: DataFrame, buildings: DataFrame) -> DataFrame:
    """Asked (query, building, text) -> (query, room): by id, number or shown number, without the building's
    code in front; lowest floor level first, then file order. rooms: room, building, number, level, ord.

    Of the rooms with one key only the first can be an answer, so a key that many share is one row of the join."""
    a = asked.join(buildings.select("building", "code"), "building", "left")
    bare = F.regexp_replace(F.trim(T.text(F.col("text"))), F.concat(F.lit("(?i)^"), F.regexp_replace(F.col("code"), "[^A-Za-z0-9]", ""), F.lit(r"[\s-]*")), F.lit(""))
    raw = F.when(T.blank_to_null(F.col("code")).isNull(), F.trim(T.text(F.col("text")))).otherwise(bare)
    a = a.withColumn("raw", raw).where(F.col("raw") != "").select("query", "building", F.explode(F.array_distinct(F.array(F.concat(F.lit("="), "raw"), F.concat(F.lit("#"), T.display_number(F.col("raw")))))).alias("k"))
    keys = F.array_distinct(F.array(F.concat(F.lit("="), "room"), F.concat(F.lit("="), "number"), F.concat(F.lit("#"), T.display_number(F.col("number")))))
    r = rooms.select("room", "building", "level", "ord", F.explode(keys).alias("k"))
    first = r.groupBy("building", "k").agg(F.min(F.struct("level", "ord", "room")).alias("r"))
    return a.join(first, ["building", "k"]).groupBy("query").agg(F.min("r").alias("r")).select("query", "r.room")


def best_target(targets: DataFrame, ident: str) -> DataFrame:
    """Per building the target of the least priority (then ord) that has a place."""
    ok = targets.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return ok.groupBy(ident).agg(F.min_by(F.struct("lat", "lng", "name", "priority"), F.struct("priority", "ord")).alias("t")).select(ident, "t.*")


def hubs_to_corridors(nodes: DataFrame, rooms: DataFrame) -> DataFrame:
    """Hubs (type room) of corridors become waypoints; rooms: room, kind."""
    r = rooms.where("kind = 'corridor'").select("room", F.lit(True).alias("__c"))
    return nodes.join(r, "room", "left").withColumn("type", F.when(F.col("__c") & (F.col("type") == "room"), "waypoint").otherwise(F.col("type"))).drop("__c")


def entrances(nodes: DataFrame, edges: DataFrame, floors: DataFrame, georef: DataFrame, facing: DataFrame) -> DataFrame:
    """(node, building, lat, lng, access, label) of located entrances.

    nodes: node, type, floor, x, y, access; edges: ord, a, b; floors: floor, building, level; georef: building, t
    (see geo.plan_to_lng_lat) and off; facing: node, bearing. The side is the given bearing, else that from the
    first inner neighbour on the same floor, else 'Building'; labels count by side and level in order of access.
    """
    at = nodes.select("node", "floor", "x", "y")
    both = symmetric(edges.select("ord", "a", "b"), "a", "b").join(at, "node")
    other = at.select(F.col("node").alias("other"), F.col("floor").alias("of"), F.col("x").alias("ix"), F.col("y").alias("iy"))
    inner = both.join(other, "other").where("floor = of").groupBy("node").agg(F.min_by(F.struct("ix", "iy"), "ord").alias("i"))
    e = nodes.where("type = 'entrance'").withColumn("access", T.access_class(F.col("access"))).join(floors, "floor").join(georef, "building")
    e = e.join(inner, "node", "left").join(facing, "node", "left")
    place = G.plan_to_lng_lat(G.point(F.col("x"), F.col("y")), F.col("t"), F.col("off"))
    out = F.coalesce("bearing", F.when(F.col("i").isNotNull(), G.plan_bearing(F.col("x") - F.col("i.ix"), F.col("y") - F.col("i.iy"), F.col("t"))))
    e = e.withColumns({"side": F.coalesce(T.compass_side(out), F.lit("Building")), "lat": G.half_up(place["y"], 6), "lng": G.half_up(place["x"], 6)})
    n = F.row_number().over(W.partitionBy("building", "side", "level").orderBy(T.access_rank(F.col("access")), "node"))
    return e.select("node", "building", "lat", "lng", "access", T.entrance_label(F.col("side"), n, F.col("level")).alias("label"))


def match_tags(spaces: DataFrame, tags: DataFrame) -> DataFrame:
    """(space, number, how): by the space's own number, then the nearest tag inside, then a synthetic number.

    spaces: space, ring, own; tags: tag, number, p. A tag serves once. Spaces take turns in their order for tags
    inside them, which one fold over all open pairs' order can't share out over tasks; so a tag goes to the
    first space that holds it, and a space to the nearest of the tags that are its own then.
    """
    by_number = tags.groupBy(F.col("number").alias("own")).agg(F.min("tag").alias("tag"))
    first = spaces.join(by_number, "own").groupBy("tag").agg(F.min_by(F.struct("space", "own"), "space").alias("s")).select(F.col("s.space").alias("space"), "tag", F.col("s.own").alias("number"), F.lit("own-number").alias("how"))
    rest = spaces.join(first.select("space"), "space", "left_anti")
    free = tags.join(first.select("tag"), "tag", "left_anti")
    from terrazzo.operators.spatial import points_in_rings

    inside = points_in_rings(free, rest, 100.0)
    mine = inside.withColumn("__n", F.row_number().over(W.partitionBy("tag").orderBy("space"))).where("__n = 1")
    d = G.dist(F.col("p"), G.centroid(F.col("ring")))
    second = mine.groupBy("space").agg(F.min_by(F.struct("tag", "number"), F.struct(d, "tag")).alias("t")).select("space", "t.tag", "t.number", F.lit("inside").alias("how"))
    left = rest.join(second.select("space"), "space", "left_anti")
    third = left.select("space", F.lit(None).cast("long").alias("tag"), F.coalesce("own", F.concat(F.lit("UNK-"), F.col("space").cast("string"))).alias("number"), F.when(F.col("own").isNotNull(), "number-without-tag").otherwise("synthetic").alias("how"))
    return reduce(DataFrame.unionByName, [first, second, third])


def infer_missing(rooms: DataFrame, openings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rooms without an opening are linked to the neighbour of greatest length, corridors counting three times.

    rooms: room, kind; openings: a, b; pairs: a, b, length of the shared wall."""
    has = openings.select(F.explode(F.array("a", "b")).alias("room")).distinct()
    lost = rooms.select("room").join(has, "room", "left_anti")
    near = symmetric(pairs, "a", "b").withColumnRenamed("node", "room").join(lost, "room")
    kinds = rooms.select(F.col("room").alias("other"), "kind")
    score = F.col("length") * F.when(F.col("kind") == "corridor", 3).otherwise(1)
    return near.join(kinds, "other").groupBy("room").agg(F.max_by("other", F.struct(score, -F.col("other"))).alias("other"))


def adjacency(samples: DataFrame, by: list[str], size: int, least: int) -> DataFrame:
    """Runs of open samples between two spaces: (by, start, n), of `least` samples or more, around the ring."""
    from terrazzo.operators.ordered import cyclic_runs

    return cyclic_runs(samples, by, "at", size, F.col("open")).where(F.col("n") >= least)


def nearest_within(gaps: DataFrame, swings: DataFrame, within: float) -> DataFrame:
    """Each gap (gap, x, y) with the nearest swing (swing, sx, sy) within reach; both sides' rest keeps its row."""
    from terrazzo.operators.spatial import nearest_points, per_place

    t = swings.select("swing", F.col("sx").alias("nx"), F.col("sy").alias("ny"))
    matched = per_place(gaps.select("gap", "x", "y"), ["x", "y"], lambda at: nearest_points(at, t, "swing", within=within), "left").select("gap", "swing")
    alone = swings.join(matched.select("swing").where("swing is not null").distinct(), "swing", "left_anti").select(F.lit(None).cast("long").alias("gap"), "swing")
    return matched.unionByName(alone)


def probe(doors: DataFrame, rings: DataFrame, size: float, steps: int, step: float) -> DataFrame:
    """From each door (door, p, dx, dy) outwards the ring of the first sample point inside one, null for none."""
    at = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")
    s = doors.select("door", "p", "dx", "dy", at)
    s = s.select("door", "k", G.point(F.col("p.x") + F.col("dx") * F.col("k") * step, F.col("p.y") + F.col("dy") * F.col("k") * step).alias("p"))
    from terrazzo.operators.spatial import points_in_rings

    hit = points_in_rings(s, rings, size).groupBy("door").agg(F.min(F.struct("k", "ring_id")).alias("r"))
    return doors.select("door").join(hit, "door", "left").select("door", F.col("r.ring_id").alias("ring_id"), F.col("r.k").alias("k"))
