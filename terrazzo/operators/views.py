"""Views of a campus for readers and editors: access by class, markers, boxes, seeds, schedules and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.functions import geo as G
from terrazzo.functions import text as T
from terrazzo.operators.spatial import strictest

CLASSED = ("waypoint", "door", "entrance")
EDGE_TOLERANCE = 12.0


def room_access(rooms: DataFrame, nodes: DataFrame) -> DataFrame:
    """P03 for rooms (room, type, access, searchable): hallways have a class, other rooms none; a hallway that a node
    of type room stands for isn't searched for."""
    hubs = nodes.where("type = 'room'").select("room").where("room is not null").distinct().withColumn("__hub", F.lit(True))
    hall = F.col("type") == "corridor"
    out = rooms.join(hubs, "room", "left")
    shown = F.when(hall & F.col("__hub"), False).otherwise(F.col("searchable"))
    return out.select("room", "type", F.when(hall, T.access_class(F.col("access"))).alias("access"), shown.alias("searchable"))


def node_access(rooms: DataFrame, nodes: DataFrame, size: float, tolerance: float = EDGE_TOLERANCE) -> DataFrame:
    """P03 for nodes (node, floor, type, room, p, access), with rooms (room, floor, type, access, ring).

    A hallway's hub becomes a waypoint of its class; waypoints take the strictest class of the hallways of their
    floor around them, within `tolerance`, if any; doors and entrances keep theirs, main unless known; others have none.
    """
    halls = rooms.where("type = 'corridor'").select("room", "floor", "ring", T.access_class(F.col("access")).alias("hall"))
    n = nodes.join(halls.select("room", "hall"), "room", "left")
    made = (F.col("type") == "room") & F.col("hall").isNotNull()
    n = n.select("node", "floor", "p", F.when(made, "waypoint").otherwise(F.col("type")).alias("type"), "access", F.when(made, F.col("hall")).alias("hub"))
    rings = halls.where(F.size("ring") >= 3).select("floor", "ring", T.access_rank(F.col("hall")).alias("rank"))
    near = strictest(n.where("type = 'waypoint' and hub is null").select("node", "floor", "p"), rings, "node", "rank", size, tolerance, ["floor"]).select("node", "rank")
    by_hall = F.get(F.array(*map(F.lit, T.ACCESS)), F.col("rank"))
    access = F.when(F.col("type").isin(*CLASSED), F.coalesce("hub", by_hall, T.access_class(F.col("access"))))
    return n.join(near, "node", "left").select("node", "type", access.alias("access"))


def entrances(nodes: DataFrame) -> DataFrame:
    """The entrance nodes with their places as numbers."""
    return nodes.where("type = 'entrance'").select("node", "floor", F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y"))


def door_markers(nodes: DataFrame) -> DataFrame:
    """Markers (id, floor, x, y, kind, title) of doors and entrances by class; main inside doors have none."""
    c, door = T.access_class(F.col("access")), F.col("type").isin("entrance", "door")
    kind = F.when(c == "emergency", "exit").when(c == "alt", "door-alt").when(F.col("type") == "entrance", "door-main")
    title = F.when(c == "emergency", "Emergency exit (not used for directions)").when(c == "alt", "Side door").otherwise("Main entrance")
    return nodes.where(door & kind.isNotNull()).select(F.concat(F.lit("class:"), F.col("node").cast("string")).alias("id"), "floor", "x", "y", kind.alias("kind"), title.alias("title"))


def floor_photos(photos: DataFrame) -> DataFrame:
    """Indoor photos with a place on their floor."""
    return photos.where("type = 'indoor' and floor is not null and x is not null and y is not null")


def hallway_classes(rooms: DataFrame) -> DataFrame:
    """(room, emergency, alt) flags by class."""
    c = T.access_class(F.col("access"))
    return rooms.select("room", (c == "emergency").alias("emergency"), (c == "alt").alias("alt"))


def walked_floors(steps: DataFrame, by: list[str]) -> DataFrame:
    """The distinct floors that a route's walking steps lie on."""
    return steps.where("kind = 'walk'").select(*by, "floor").distinct()


def room_center(x: Column, y: Column, ring: Column) -> Column:
    """the stored center, else the mean of the ring's points; null without both."""
    mean = lambda f: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[f]), F.size(ring))
    none = x.isNull()
    return G.point(F.when(none, mean("x")).otherwise(x), F.when(none, mean("y")).otherwise(y))


def box_of(points: Column) -> Column:
    """struct(x, y, w, h) of points; null of none."""
    e = G.envelope(points)
    return F.when(F.size(points) > 0, F.struct(e["min_x"].alias("x"), e["min_y"].alias("y"), (e["max_x"] - e["min_x"]).alias("w"), (e["max_y"] - e["min_y"]).alias("h")))


def focus_box(box: Column, width: Column, height: Column, parts: float = 2.2) -> Column:
    """The box grown about its middle to a share of the whole plan at least: 2.2 for a room, 3 for points."""
    w, h = F.greatest(box["w"], width / parts), F.greatest(box["h"], height / parts)
    return F.struct((box["x"] + box["w"] / 2 - w / 2).alias("x"), (box["y"] + box["h"] / 2 - h / 2).alias("y"), w.alias("w"), h.alias("h"))


def close_ring(ring: Column, flag: Column) -> Column:
    """struct(method, gap): how a polyline closes, by its flag, by endpoints within 0.01, else by an implied edge."""
    gap = F.coalesce(G.dist(F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)), F.lit(0.0))
    return F.struct(F.when(flag, "closed-flag").when(gap <= 0.01, "coincident-endpoints").otherwise("implied-closing-edge").alias("method"), gap.alias("gap"))


def tenths(c: Column) -> Column:
    """A number rounded half up to tenths, as text without needless zeros."""
    v = F.floor(c * 10 + 0.5)
    return F.when(v % 10 == 0, (v / 10).cast("long").cast("string")).otherwise((v / 10).cast("decimal(20,1)").cast("string"))


def ring_path(ring: Column) -> Column:
    """A ring as path commands: M, then L a point, then Z; empty for no points."""
    each = F.transform(ring, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), tenths(p["x"]), F.lit(" "), tenths(p["y"])))
    return F.when(F.size(ring) > 0, F.concat(F.array_join(each, ""), F.lit("Z"))).otherwise("")


def segments(paths: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """(…by, pos, a, b): the sides of open and closed paths (points, closed) that are longer than `least`."""
    p = paths.select(*by, "points", F.posexplode("points").alias("pos", "a"), "closed")
    n = F.size("points")
    b = F.when(F.col("pos") + 1 < n, F.get("points", F.col("pos") + 1)).when(F.col("closed") & (n > 2), F.get("points", F.lit(0)))
    return p.withColumn("b", b).where(F.col("b").isNotNull() & (G.dist(F.col("a"), F.col("b")) > least)).select(*by, "pos", "a", "b")


def node_class(kind: Column, access: Column) -> Column:
    """A node's own class; main for other doors, waypoints and entrances; empty for the rest."""
    return F.coalesce(F.nullif(access, F.lit("")), F.when(kind.isin(*CLASSED), "main"), F.lit(""))


def carried(entrances_: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of an entrances block whose node is still an entrance."""
    return entrances_.join(nodes.where("type = 'entrance'").select("node"), "node", "left_semi")


def has_indoor(buildings: DataFrame, floors: DataFrame) -> DataFrame:
    """(building, indoor): not flagged false, and with a floor."""
    some = floors.select("building").distinct().withColumn("__some", F.lit(True))
    b = buildings.join(some, "building", "left")
    return b.select("building", (F.coalesce("__some", F.lit(False)) & F.coalesce(T.to_bool(F.col("flag")), F.lit(True))).alias("indoor"))


def building_seeds(base: DataFrame, overrides: DataFrame, levels: DataFrame) -> DataFrame:
    """Base rows (building, name, …) with the name, code, number and indoor flag of an override and generated
    levels and height; blanks where there are none."""
    o = overrides.select("building", F.col("name").alias("__name"), "code", "number", F.col("indoor").alias("__indoor"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rest = [c for c in base.columns if c not in ("building", "name")]
    out = base.join(o, "building", "left").join(levels.select("building", "levels", "height"), "building", "left")
    name = F.coalesce(F.nullif(F.col("__name"), F.lit("")), F.col("name"))
    return out.select("building", name.alias("name"), text("code").alias("code"), text("number").alias("number"), *rest, F.coalesce("__indoor", F.lit(False)).alias("indoor"), text("levels").alias("levels"), text("height").alias("height"))


def node_seeds(nodes: DataFrame, generated: DataFrame) -> DataFrame:
    """Nodes (node, type, access, …); an entrance takes the generated class if it has one, blank for null."""
    g = generated.select("node", F.nullif(F.col("access"), F.lit("")).alias("__access"))
    access = F.coalesce(F.when(F.col("type") == "entrance", F.col("__access")), F.col("access"), F.lit(""))
    return nodes.join(g, "node", "left").withColumn("access", access).drop("__access")


def with_private(rows: DataFrame, private: DataFrame | None) -> DataFrame:
    """Generated rows, and the private ones when they are loaded."""
    return rows if private is None else rows.unionByName(private, allowMissingColumns=True)


def typed_tab(cells: DataFrame, json: dict[str, str], bools: dict[str, bool], times: tuple[str, ...] = ()) -> DataFrame:
    """A tab of text cells as records: JSON columns parsed by their schema, null where they are no JSON; flags by
    to_bool with their default; times as ISO text; all else as it is. Columns without a name are dropped."""

    def of(c: str) -> Column:
        v = F.col(f"`{c}`")
        if c in json:
            return F.from_json(v, json[c])
        if c in bools:
            return T.to_bool(v, bools[c])
        return F.date_format(F.try_to_timestamp(v), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if c in times else v

    return cells.select(*(of(c).alias(c) for c in cells.columns if c.strip()))


def map_inputs(nodes: DataFrame, buildings: DataFrame) -> DataFrame:
    """Rows (part, id, fields) of what a map build depends on; two saves with the same rows need no rebuild."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    e = entrances(nodes).join(nodes.select("node", "access"), "node")
    e = e.select(F.lit("entrance").alias("part"), F.col("node").cast("string").alias("id"), F.to_json(F.array(text("floor"), text("x"), text("y"), text("access"))).alias("fields"))
    b = buildings.select(F.lit("building").alias("part"), F.col("building").cast("string").alias("id"), F.to_json(F.array(text("levels"), text("height"))).alias("fields"))
    return e.unionByName(b)


def snap_targets(layers: DataFrame, drawn: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (target, id, coordinates): lines of base paths and roads, drawn paths, drawn and mapped entrances."""
    line = layers.where("layer in ('paths', 'roads') and kind = 'LineString'").select(F.lit("line").alias("target"), F.coalesce("id", "layer").alias("id"), "coordinates")
    own = drawn.select(F.when((F.col("layer") == "paths") & (F.col("kind") == "LineString"), "line").when((F.col("layer") == "entrances") & (F.col("kind") == "Point"), "entrance").alias("target"), "id", "coordinates").where("target is not null")
    at = F.to_json(F.array("lng", "lat"))
    return line.unionByName(own).unionByName(nodes.where("type = 'entrance'").select(F.lit("entrance").alias("target"), F.col("node").cast("string").alias("id"), at.alias("coordinates")))


def editor_entrances(nodes: DataFrame, floors: DataFrame, labels: DataFrame) -> DataFrame:
    """Located entrances with building ('' if the floor has none), label (else the id), class and whether it is set."""
    n = nodes.where("type = 'entrance' and lat is not null and lng is not null")
    n = n.join(floors.select("floor", "building"), "floor", "left").join(labels.select("node", "label"), "node", "left")
    set_ = F.coalesce(F.col("access") != "", F.lit(False))
    return n.select("node", F.coalesce(F.col("building").cast("string"), F.lit("")).alias("building"), "floor", "lat", "lng", F.coalesce("label", F.col("node").cast("string")).alias("label"), F.when(set_, F.col("access")).otherwise("main").alias("access"), set_.alias("explicit"))


def decide(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """(room, decision) after changes (ord, room, decision) in order; a blank decision takes the room off the list."""
    last = changes.groupBy("room").agg(F.max_by("decision", "ord").alias("decision"))
    return decisions.join(last, "room", "left_anti").select("room", "decision").unionByName(last.where("decision in ('accepted', 'rejected')"))


def review(candidates: DataFrame, decisions: DataFrame, rooms: DataFrame) -> DataFrame:
    """Candidates (room, floor, confidence) with floor, label and decision; a room that is a corridor is accepted."""
    r = rooms.select("room", F.col("floor").alias("__floor"), "type", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("number")).alias("__label"))
    out = candidates.join(decisions, "room", "left").join(r, "room", "left")
    decision = F.coalesce(F.nullif(F.col("decision"), F.lit("")), F.when(F.col("type") == "corridor", "accepted"), F.lit(""))
    return out.select("room", F.coalesce("floor", "__floor").alias("floor"), F.coalesce("__label", F.col("room").cast("string")).alias("label"), "confidence", decision.alias("decision"))


def schedule(events: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Each owner's list with `place`, by time as text: events of a list (ord, id, time, building, room) and
    additions, the first of one time, building and room; those that `changes` (id) removes are out."""
    same = W.partitionBy(*by, "time", "building", F.col("room").cast("string")).orderBy("ord")
    kept = events.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n").join(changes.select(*by, "id"), [*by, "id"], "left_anti")
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.col("time").cast("string"), "ord")))


def event_place(building: Column, title: Column) -> Column:
    """Where an official event is: the building, and the room's title if it has one."""
    return F.concat(building, F.coalesce(F.concat(F.lit(" · "), title), F.lit("")))


def room_choices(rooms: DataFrame, floors: DataFrame) -> DataFrame:
    """(building, place, room, text): a building's searchable rooms in natural order of their numbers."""
    from terrazzo.operators.search import natural_key

    r = rooms.where(T.to_bool(F.col("searchable"), True)).join(floors.select("floor", "building", "code"), "floor")
    use = T.use_text(F.col("label"), F.col("number"))
    text = F.concat(T.room_title(F.col("number"), F.col("room").cast("string"), F.col("code")), F.when(use != "", F.concat(F.lit(" – "), use)).otherwise(""))
    order = W.partitionBy("building").orderBy(natural_key(F.col("number")), "room")
    return r.select("building", F.row_number().over(order).alias("place"), "room", text.alias("text"))


def footprints(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(osm_id, name, ring) of buildings: closed ways, and of each multipolygon the largest ring, the first of equals.

    ways: id, tags, ring, closed; relations: id, tags, rings (arrays of points).
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    built = F.coalesce(tag("building") != "", F.lit(False))
    name = F.coalesce(tag("name"), F.lit("")).alias("name")
    w = ways.where(built & F.col("closed")).select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("osm_id"), name, "ring")
    r = relations.where(built & F.coalesce(tag("type") == "multipolygon", F.lit(False)) & (F.size("rings") > 0))
    sized = F.transform("rings", lambda x, i: F.struct(F.abs(G.area(x)).alias("a"), (-i).alias("i"), x.alias("ring")))
    return w.unionByName(r.select(F.concat(F.lit("relation/"), F.col("id").cast("string")).alias("osm_id"), name, F.array_max(sized)["ring"].alias("ring")))


def with_labels(layers: dict[str, DataFrame], buildings: DataFrame) -> DataFrame:
    """The layers' features (id, kind, name, ring or line as `points`) in one table, with a label at the label point
    of every named building, parking and green."""
    out = None
    for name, df in layers.items():
        part = df.select(F.lit(name).alias("layer"), "id", "kind", "name", "points")
        out = part if out is None else out.unionByName(part)
    named = buildings.select(F.lit("building").alias("kind"), "name", "id", "points").unionByName(out.where("layer in ('parking', 'landuse')").select("kind", "name", "id", "points"))
    labels = named.where("name <> ''").select(F.lit("labels").alias("layer"), "id", "kind", "name", F.array(G.label_point(F.col("points"))).alias("points"))
    return out.unionByName(labels)


def merged_openings(found: DataFrame, by: list[str]) -> DataFrame:
    """Openings (ord, a, b, p, width) of one pair merged where midpoints lie within the greater of 24 and half the
    lesser width: the mean of the midpoints, taken one after another, and the greatest width.

    A pair's openings fold in order within its row; a pair has as many as two spaces have doors.
    """
    rows = found.groupBy(*by, "a", "b").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("width").alias("w")))).alias("o"))
    none = F.array().cast("array<struct<x:double,y:double,w:double>>")

    def fold(acc: Column, o: Column) -> Column:
        near = lambda m: F.hypot(m["x"] - o["x"], m["y"] - o["y"]) < F.greatest(F.lit(24.0), F.least(m["w"], o["w"]) / 2)
        at = F.array_position(F.transform(acc, near), True)
        new = F.struct(o["x"].alias("x"), o["y"].alias("y"), o["w"].alias("w"))
        joined = F.transform(acc, lambda m, i: F.when(i + 1 == at, F.struct(((m["x"] + o["x"]) / 2).alias("x"), ((m["y"] + o["y"]) / 2).alias("y"), F.greatest(m["w"], o["w"]).alias("w"))).otherwise(m))
        return F.when(at > 0, joined).otherwise(F.array_append(acc, new))

    return rows.select(*by, "a", "b", F.explode(F.aggregate("o", none, fold)).alias("m")).select(*by, "a", "b", "m.x", "m.y", F.col("m.w").alias("width"))


def floor_svg(rooms: DataFrame, floors: DataFrame) -> DataFrame:
    """(floor, svg): a plain plan of a floor's room rings (three points or more), in order of room; floors without one are out.

    A floor's rooms are one row. The plan is as wide and high as the floor says, else as its rooms reach.
    """
    number = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    d = F.array_join(F.transform("ring", lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), number(p["x"]), F.lit(" "), number(p["y"]))), " ")
    path = F.concat(F.lit('<path data-room-id="'), T.escape_html(F.col("room").cast("string")), F.lit('" d="'), d, F.lit(' Z"/>'))
    e = G.envelope(F.col("ring"))
    drawn = rooms.where(F.size("ring") >= 3).select("floor", "room", path.alias("path"), e.alias("e"))
    drawn = drawn.groupBy("floor").agg(F.array_sort(F.collect_list(F.struct("room", "path"))).alias("paths"), *(f(f"e.{c}").alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))))
    zero = F.lit(0.0)
    w = F.coalesce(F.nullif(F.col("width"), zero), F.col("max_x") + F.greatest(zero, F.col("min_x")))
    h = F.coalesce(F.nullif(F.col("height"), zero), F.col("max_y") + F.greatest(zero, F.col("min_y")))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), number(w), F.lit(" "), number(h), F.lit('"><g id="rooms">'))
    return drawn.join(floors.select("floor", "width", "height"), "floor", "left").select("floor", F.concat(head, F.array_join(F.transform("paths", lambda p: p["path"]), ""), F.lit("</g></svg>")).alias("svg"))


def with_version(url: Column, version: Column) -> Column:
    """A URL with its version as a parameter, if there is one."""
    return F.when(T.text(version) == "", url).otherwise(F.concat(url, F.lit("?v="), F.url_encode(version.cast("string"))))


def page_url(href: Column) -> Column:
    """A page's own URL without query and fragment."""
    return F.regexp_extract(T.text(href), r"^([^#?]*)", 1)


def is_id(c: Column) -> Column:
    """1 to 80 letters, digits, _ and -."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]{1,80}$"), F.lit(False))


def payload_choice(ok: Column, matches: Column, cached: Column) -> Column:
    """What to show after a fetch: `new` if it is of the advertised version, else the saved copy as `stale`, else
    the `other` payload under its own version, else `none`; no payload is given another version."""
    return F.when(ok & matches, "new").when(cached, "stale").when(ok, "other").otherwise("none")
