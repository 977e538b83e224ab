"""Scalar text functions: normal forms, tokens, display texts, parsing, encoding, clocks and predicates.

Every function takes and returns columns. Blank means null or empty after trimming, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")
ACCESS = ("main", "alt", "emergency")
NAME_STOP_WORDS = ("the", "building", "hall", "center", "of", "and", "school")
COMPASS = ("North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest")
# The kinds of ways and areas that rules P05, P06, P10, P11, P15 and P16 tell apart.
PATH_KINDS = {"footway": "footway", "path": "path", "pedestrian": "pedestrian", "steps": "steps", "cycleway": "path", "bridleway": "path", "corridor": "footway"}
WALKABLE_ROADS = ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "service", "living_street", "track", "road")
ROAD_KINDS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street", "track", "road", "primary_link", "secondary_link", "tertiary_link", "trunk_link")
GREEN = {
    "landuse": ("grass", "meadow", "recreation_ground", "village_green", "forest", "cemetery", "orchard"),
    "leisure": ("park", "pitch", "garden", "track", "stadium", "golf_course", "playground", "sports_centre", "recreation_ground"),
    "natural": ("wood", "scrub", "grassland", "heath", "wetland"),
}
LINE_PATHS = ("footway", "path", "pedestrian", "steps", "crossing", "sidewalk", "cycleway", "track", "bridleway")
WATERS = ("water", "pond", "basin", "reservoir", "river", "stream", "canal", "lake")
PARKINGS = ("parking", "parking_space", "parking-lot", "parking_lot")
LAYER_HINTS = {
    "paths": ("paths", "path", "footways", "footway"),
    "roads": ("roads", "road", "service"),
    "parking": ("parking",),
    "landuse": ("landuse", "green", "greens", "grass", "park"),
    "water": ("water",),
    "labels": ("labels", "label"),
}
METERS_A_LEVEL = 3.5
RESIDENCE_TAG, RESIDENCE_NAME, ACADEMIC_TAG = "^(dormitory|residential|apartments)$", r"\bCollege$|College Courts|Suites|Apartments|Heritage Hall", "^(university|school|college)$"
EVENTS = ("search", "route_start", "route_from", "route_reroute", "floor_change", "qr_scan", "sched_open")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def norm(c: Column) -> Column:
    """lower case, & as the word and, everything but letters and digits a single space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def strip_zeros(c: Column) -> Column:
    """no leading zeros before a further digit."""
    return F.regexp_replace(c, r"^0+(?=\d)", "")


def tokens(c: Column) -> Column:
    """the words of the normal form, split where digits follow a letter, numbers without leading zeros."""
    parts = F.split(F.regexp_replace(norm(c), r"([a-z])(\d)", "$1 $2"), " +")
    return F.transform(F.filter(parts, lambda p: p != ""), strip_zeros)


def display_number(c: Column) -> Column:
    """a number as shown: trimmed, no leading zeros, upper case."""
    return F.upper(strip_zeros(F.trim(text(c))))


def use_text(label: Column, number: Column) -> Column:
    """a label without the number that it repeats as its first word."""
    t, n = F.trim(text(label)), display_number(number)
    first = F.regexp_extract(t, r"^(\S*)", 1)
    return F.when((n != "") & (F.upper(first) == n), F.ltrim(F.substr(t, F.length(first) + 1))).otherwise(t)


def type_text(kind: Column) -> Column:
    """a type with a capital first letter; `other` and blanks are empty."""
    t = F.trim(text(kind))
    return F.when((t == "") | (norm(t) == "other"), "").otherwise(F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2))))


def prefix_of_any(tok: Column, words: Column) -> Column:
    """of the first word that begins with tok: 2 if it is tok, else 1; 0 without such a word."""
    first = F.get(F.filter(words, lambda w: F.startswith(w, tok)), F.lit(0))
    return F.when(first.isNull(), 0).when(first == tok, 2).otherwise(1)


def name_tokens(c: Column, stop_words: tuple[str, ...] = NAME_STOP_WORDS) -> Column:
    """the distinct words of two or more signs that aren't stop words."""
    plain = F.regexp_replace(F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]+", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= 2)
    return F.array_except(words, F.array(*map(F.lit, stop_words)))


def name_similarity(a: Column, b: Column) -> Column:
    """Shared words over the smaller set's size, from token arrays; 0 if either has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def canonical(m: Column) -> Column:
    """a map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def to_bool(c: Column, default: bool | None = None) -> Column:
    """true/1/yes and false/0/no in any case; blanks and all else take the default."""
    t = F.lower(F.trim(text(c)))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).otherwise(F.lit(default))


def truthy(c: Column) -> Column:
    """F14's second form: blank and unknown are false."""
    return to_bool(c, False)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(text(c)) == "", F.lit(None)).otherwise(c)


def cell(present: Column, new: Column, old: Column) -> Column:
    """an absent field keeps the old value, a present one replaces it, also by null."""
    return F.when(present, new).otherwise(old)


def number_of(c: Column) -> Column:
    """F16: a plain decimal number, else null."""
    t = F.trim(text(c))
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double"))


def parse_area(c: Column) -> Column:
    """the first number in a text, without its thousands commas."""
    return F.replace(F.regexp_extract(text(c), r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def is_circulation_number(c: Column) -> Column:
    """numbers such as 100, 2200 or 300B."""
    return F.coalesce(c.rlike(r"^\d?\d00[A-Z]?$"), F.lit(False))


def plan_asset_name(floor_id: Column) -> Column:
    """the asset that holds a floor's plan: the id with hyphens as underscores."""
    return F.concat(F.lit("FP_"), F.replace(floor_id, F.lit("-"), F.lit("_")))


def query_params(query: Column, raw: tuple[str, ...] = ("qr",)) -> Column:
    """a map of a query string's parameters; the first of a name wins; + and % are decoded but for `raw` names."""
    parts = F.filter(F.split(F.regexp_replace(text(query), r"^\?", ""), "&"), lambda p: p != "")
    name = lambda p: F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1))
    value = lambda p: F.regexp_extract(p, "^[^=]*=(.*)$", 1)
    pairs = F.transform(parts, lambda p: F.struct(name(p).alias("key"), F.when(name(p).isin(*raw), value(p)).otherwise(F.try_url_decode(value(p))).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def query_part(url: Column) -> Column:
    return F.regexp_extract(text(url), r"\?([^#]*)", 1)


def query_param(url: Column, name: str) -> Column:
    """one parameter of a URL, decoded; null if absent."""
    return F.try_element_at(query_params(query_part(url), ()), F.lit(name))


def encode_payload(json: Column) -> Column:
    """JSON text as UTF-8, base64, URL-encoded."""
    return F.url_encode(F.base64(F.encode(json, "UTF-8")))


def decode_payload(payload: Column) -> Column:
    """F23's inverse; null where the text is no such payload."""
    return F.decode(F.try_to_binary(F.try_url_decode(payload), F.lit("base64")), "UTF-8")


def format_time(hhmm: Column) -> Column:
    """HH:MM on a 12-hour clock; any other text as it is, null as empty."""
    h, m = F.regexp_extract(text(hhmm), r"^(\d{1,2}):(\d{2})$", 1).try_cast("int"), F.regexp_extract(text(hhmm), r"^(\d{1,2}):(\d{2})$", 2)
    hour = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.when(h.isNull(), text(hhmm)).otherwise(F.concat(hour.cast("string"), F.lit(":"), m, F.when(h >= 12, " PM").otherwise(" AM")))


def format_date(d: Column) -> Column:
    """a date, or its text YYYY-MM-DD, in words; any other text as it is, null as empty."""
    words = F.date_format(F.try_to_timestamp(F.left(d.cast("string"), F.lit(10)), F.lit("yyyy-MM-dd")), "EEEE, MMMM d, yyyy")
    return F.coalesce(words, text(d))


def safe_link(url: Column) -> Column:
    """the link if it is http(s) without white space, quotes and angle brackets, else empty."""
    return F.when(text(url).rlike(r"""^https?://[^\s"'<>]+$"""), url).otherwise("")


def drive_direct_url(url: Column) -> Column:
    """the direct view address of a shared file, by /d/<id> or else the id parameter; other text as it is."""
    by_path, by_name = F.regexp_extract(text(url), r"/d/([a-zA-Z0-9_-]+)", 1), F.regexp_extract(text(url), r"[?&]id=([a-zA-Z0-9_-]+)", 1)
    ident = F.when(by_path != "", by_path).otherwise(by_name)
    return F.when(ident != "", F.concat(F.lit("https://drive.google.com/uc?export=view&id="), ident)).otherwise(text(url))


def escape_html(c: Column) -> Column:
    """F27."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parse_json(c: Column, schema: str, default: Column) -> Column:
    """parsed JSON, or the default where the text is none."""
    return F.coalesce(F.from_json(c, schema), default)


def version_of(*candidates: Column) -> Column:
    """the first candidate that is a version: 1 to 80 letters, digits, _ and -."""
    return F.coalesce(*(F.when(c.rlike("^[A-Za-z0-9_-]{1,80}$"), c) for c in candidates))


def event_label(name: Column, label: Column, allowed: tuple[str, ...] = EVENTS) -> Column:
    """struct(path, title) of a listed event, else null; the title is the label, or the name without one, in at
    most 60 word signs, spaces, full stops, colons and hyphens."""
    title = F.left(F.regexp_replace(F.when(text(label) == "", name).otherwise(text(label)), "[^A-Za-z0-9_ .:-]", ""), F.lit(60))
    return F.when(name.isin(*allowed), F.struct(name.alias("path"), title.alias("title")))


def endpoint_for(site: Column, host: str = "goatcounter.com") -> Column:
    """a code of up to 63 letters, digits and hyphens becomes its counter's address on `host`, an https address
    stays, all else is empty."""
    t = F.regexp_replace(text(site), r"^\s+|\s+$", "")
    code = F.concat(F.lit("https://"), F.lower(t), F.lit(f".{host}/count"))
    return F.when(t.rlike(r"""^https://[^\s"'<>]+$"""), t).when(t.rlike("^[A-Za-z0-9][A-Za-z0-9-]{0,62}$"), code).otherwise("")


def compass_side(degrees: Column) -> Column:
    """F32: the nearest of eight points."""
    at = F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), at + 1)


def entrance_label(side: Column, n: Column, level: Column) -> Column:
    """side, ordinal when above one, level when above one."""
    return F.concat(side, F.lit(" entrance"), F.when(n > 1, F.concat(F.lit(" "), n.cast("string"))).otherwise(""), F.when(level > 1, F.concat(F.lit(", level "), level.cast("string"))).otherwise(""))


def feature_id(ident: Column, order: Column) -> Column:
    """the id, or override/<n> by place."""
    return F.coalesce(ident.cast("string"), F.concat(F.lit("override/"), order.cast("string")))


def room_title(number: Column, ident: Column, code: Column) -> Column:
    """the building's code, if any, and the number as shown, or the id without one."""
    return F.concat(F.when(text(code) != "", F.concat(code, F.lit(" "))).otherwise(""), F.coalesce(F.nullif(display_number(number), F.lit("")), text(ident)))


def door_name(own: Column, label: Column, meters: Column, side: Column) -> Column:
    """what a door is called: its building's label for it, its own, the side if it lies over 4 m from the center, else entrance."""
    return F.coalesce(F.nullif(text(own), F.lit("")), F.nullif(text(label), F.lit("")), F.when(meters > 4, F.concat(side, F.lit(" entrance"))), F.lit("entrance"))


def expired(permanent: Column, expires: Column, now: Column) -> Column:
    """not permanent and a readable expiry before now."""
    return ~F.coalesce(permanent, F.lit(False)) & F.coalesce(F.try_to_timestamp(expires) < now, F.lit(False))


def access_class(c: Column) -> Column:
    """A known class in any case, else main."""
    t = F.lower(text(c))
    return F.when(t.isin(*ACCESS), t).otherwise(ACCESS[0])


def override_access(access: Column, primary: Column) -> Column:
    """An exact class, else what the older primary flag stands for, else null."""
    return F.when(access.isin(*ACCESS), access).when(primary.isNotNull(), F.when(primary, ACCESS[0]).otherwise(ACCESS[1]))


def access_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ACCESS)), c).cast("int") - 1


def is_public(flag: Column) -> Column:
    """Public unless false, as a boolean or as text."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))) != "false", F.lit(True))


def is_searchable(kind: Column, room_type: Column) -> Column:
    """No chase, and no corridor or mechanical room."""
    return ~F.coalesce(kind == "chase", F.lit(False)) & ~F.coalesce(room_type.isin("corridor", "mechanical"), F.lit(False))


def _tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def _is(c: Column, *values: str) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def walk_kind(tags: Column) -> Column:
    """How a tagged way is walked, or null. Areas are out; foot=no and closed access without a foot right bar
    roads but not footways; drive-through lanes are no roads to walk on."""
    foot, highway = _tag(tags, "foot"), _tag(tags, "highway")
    barred = _is(foot, "no") | (_is(_tag(tags, "access"), "no", "private") & ~_is(foot, "yes", "designated", "permissive"))
    road = ~barred & _is(highway, *WALKABLE_ROADS) & ~_is(_tag(tags, "service"), "drive-through")
    return F.when(_is(_tag(tags, "area"), "yes"), F.lit(None)).otherwise(F.coalesce(path_kind(tags), F.when(road, "road")))


def path_kind(tags: Column) -> Column:
    """The kind of a path, or null if the tags are of none: crossings by their own name, others by PATH_KINDS."""
    highway = _tag(tags, "highway")
    kinds = F.create_map(*(F.lit(x) for kv in PATH_KINDS.items() for x in kv))
    crossing = _is(highway, "footway", "path", "cycleway") & _is(_tag(tags, "footway"), "crossing")
    return F.when(crossing, "crossing").otherwise(F.try_element_at(kinds, F.coalesce(highway, F.lit(""))))


def path_access(kind: Column) -> Column:
    """Roads are a second choice."""
    return F.when(kind == "road", ACCESS[1]).otherwise(ACCESS[0])


def auto_entrance_access(chosen: Column, room_type: Column) -> Column:
    """The chosen door is main, a stair's emergency, any other alt."""
    return F.when(chosen, ACCESS[0]).when(room_type == "stair", ACCESS[2]).otherwise(ACCESS[1])


def first_layer(tags: Column, closed: Column, positions: Column) -> Column:
    """P10: struct(layer, kind, shape) of a way, by the first rule that its tags, its being closed and its number of
    positions meet; null if none does."""
    t = lambda k: _tag(tags, k)
    set_ = lambda k: F.coalesce(t(k) != "", F.lit(False))
    of = lambda layer, kind, shape: F.struct(F.lit(layer).alias("layer"), kind.alias("kind"), F.lit(shape).alias("shape"))
    path, line = path_kind(tags), ~_is(t("area"), "yes")
    out = (
        F.when(positions < 2, F.lit(None))
        .when(path.isNotNull() & line, of("paths", path, "LineString"))
        .when(_is(t("highway"), *ROAD_KINDS) & line, of("roads", t("highway"), "LineString"))
        .when(_is(t("highway"), "pedestrian") & closed, of("landuse", F.lit("plaza"), "Polygon"))
        .when(~closed, F.when(set_("waterway"), of("water", t("waterway"), "LineString")))
        .when(set_("building"), F.lit(None))
        .when(_is(t("amenity"), "parking"), of("parking", F.lit("parking"), "Polygon"))
        .when(_is(t("natural"), "water") | _is(t("landuse"), "reservoir", "basin"), of("water", F.lit("water"), "Polygon"))
    )
    for key, kinds in GREEN.items():
        out = out.when(_is(t(key), *kinds), of("landuse", t(key), "Polygon"))
    return out


def base_layer(layer: Column, hint: Column, shape: Column, kind: Column, steps: Column) -> Column:
    """The layer of a drawn feature: by its own layer, its file's hint, else its shape and kind."""
    known = F.create_map(*(F.lit(x) for name, hints in LAYER_HINTS.items() for h in hints for x in (h, name)))
    k = F.lower(text(kind))
    by_line = F.when(k.isin(*LINE_PATHS) | F.coalesce(steps, F.lit(False)), "paths").when(k.isin(*WATERS), "water").otherwise("roads")
    by_shape = F.when(_is(shape, "Point", "MultiPoint"), "labels").when(text(shape).contains("LineString"), by_line).when(k.isin(*PARKINGS), "parking").when(k.isin(*WATERS), "water").otherwise("landuse")
    return F.coalesce(F.try_element_at(known, F.lower(text(layer))), F.try_element_at(known, F.lower(text(hint))), by_shape)


def clean_map(m: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(m, lambda _, v: F.coalesce(v != "", F.lit(False)))


def trim_tags(m: Column, keep: str) -> Column:
    """The map's entries whose key matches the pattern, in key order; null if none does."""
    kept = F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: k.rlike(keep))))
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def default_levels(building: Column, name: Column) -> Column:
    """struct(levels, type) by the building tag and the seeded name: residence 4, academic 3, other 2."""
    b, n = text(building), text(name)
    of = lambda levels, kind: F.struct(F.lit(levels).cast("double").alias("levels"), F.lit(kind).alias("type"))
    return F.when(b.rlike(RESIDENCE_TAG) | n.rlike(RESIDENCE_NAME), of(4, "residence")).when(b.rlike(ACADEMIC_TAG) | (n != ""), of(3, "academic")).otherwise(of(2, "other"))


def positive_number(c: Column) -> Column:
    """The number that a text begins with, a comma as its point; null unless above 0."""
    lead = F.regexp_extract(F.regexp_replace(text(c), "^([^,]*),", "$1."), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    v = lead.try_cast("double")
    return F.when((v > 0) & (v < float("inf")), v)


def building_height(tags: Column, height: Column, levels: Column, name: Column) -> Column:
    """struct(height, levels, source): the override's height, its levels, the tagged height, tagged levels, a
    roof's 4 m, else the default by type, the first that is there. Heights are rounded to tenths."""
    per = F.lit(METERS_A_LEVEL)
    oh, ol, th, tl = positive_number(height), positive_number(levels), positive_number(_tag(tags, "height")), positive_number(_tag(tags, "building:levels"))
    tenth = lambda v: F.floor(v * 10 + 0.5) / 10
    floors = lambda v: F.greatest(F.lit(1.0), F.floor(v / per + 0.5).cast("double"))
    of = lambda h, n, source: F.struct(tenth(h).alias("height"), n.cast("double").alias("levels"), F.lit(source).alias("source"))
    d = default_levels(_tag(tags, "building"), name)["levels"]
    return (
        F.when(oh.isNotNull(), of(oh, F.coalesce(ol, tl, floors(oh)), "override"))
        .when(ol.isNotNull(), of(ol * per, ol, "override"))
        .when(th.isNotNull(), of(th, F.coalesce(tl, floors(th)), "osm"))
        .when(tl.isNotNull(), of(tl * per, tl, "osm"))
        .when(_is(_tag(tags, "building"), "roof"), of(F.lit(4.0), F.lit(1.0), "default"))
        .otherwise(of(d * per, d, "default"))
    )


def routing_number(value: Column, default: float, least: float | None = None, repair: float | None = None) -> Column:
    """A finite number from text, else the default; below `least`, `repair` (the default unless given)."""
    v = number_of(value)
    if least is None:
        return F.coalesce(v, F.lit(default))
    return F.when(v >= least, v).when(v < least, F.lit(default if repair is None else repair)).otherwise(F.lit(default))


def directions_url(lat: Column, lng: Column, apple: bool = False) -> Column:
    """A link to an outside map with an encoded destination."""
    base = "https://maps.apple.com/?daddr=" if apple else "https://www.google.com/maps/dir/?api=1&destination="
    return F.concat(F.lit(base), F.url_encode(F.concat_ws(",", lat.cast("string"), lng.cast("string"))))
