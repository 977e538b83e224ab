"""Queries of text functions and search, over part, events, pages, orders and nation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import text as T
from terrazzo.operators import search as S
from terrazzo.session import table

QUERY = "brand 1 red w"
#: A part as a room: its number, a label that repeats it, its brand as the building.
_ROOM = "lpad(CAST(p_partkey AS VARCHAR), 6, '0')"


def _padded(key: str) -> Column:
    """A key as a number of six digits or, beyond these, of all that it has."""
    k = F.col(key).cast("string")
    return F.lpad(k, F.greatest(F.length(k), F.lit(6)), F.lit("0"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1)
    rooms = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), _padded("p_partkey").alias("number"), F.col("p_name").alias("label"), F.col("p_type").alias("type"), brand.alias("building_id"))
    buildings = part.select(brand.alias("id"), F.regexp_replace("p_brand", "#", " ").alias("name"), F.concat(F.lit("b"), brand).alias("code")).distinct()
    return S.build_index(rooms, buildings)


def f01_f06_forms(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    raw = F.concat(F.lit(" "), "p_name", F.lit(" & "), "p_brand", F.lit("A0"), F.col("p_size").cast("string"))
    number = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    label = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name")
    return p.select(
        "p_partkey",
        T.norm(raw).alias("f01_norm"),
        F.concat_ws("|", T.tokens(raw)).alias("f02_tokens"),
        T.strip_zeros(number).alias("f03_strip"),
        T.display_number(F.concat(number, F.lit("b"))).alias("f04_number"),
        T.use_text(label, _padded("p_partkey")).alias("f05_use"),
        T.type_text(F.when(F.col("p_size") % 5 == 0, "Other ").otherwise(F.lower("p_type"))).alias("f06_type"),
        F.concat_ws("|", F.array_sort(T.name_tokens(F.concat(F.lit("The Hall of "), "p_name")))).alias("f11_names"),
        T.room_title(F.when(F.col("p_size") % 4 != 0, number), F.concat(F.lit("rm"), "p_partkey"), F.when(F.col("p_size") % 2 == 0, "B1")).alias("f36_title"),
        T.door_name(F.when(F.col("p_partkey") % 5 == 0, "East door"), F.when(F.col("p_partkey") % 7 == 0, "Dock"), F.col("p_size") % 9, F.lit("North")).alias("f36_door"),
    )


_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_RAW = "(' ' || p_name || ' & ' || p_brand || 'A0' || p_size)"
_STRIP = "regexp_replace({0}, '^0+(\\d)', '\\1')"
_FORMS = f"""
SELECT p_partkey, {_NORM.format(_RAW)} AS f01_norm,
  array_to_string(list_transform(list_filter(string_split(regexp_replace({_NORM.format(_RAW)}, '([a-z])(\\d)', '\\1 \\2', 'g'), ' '), lambda x: x <> ''), lambda x: {_STRIP.format('x')}), '|') AS f02_tokens,
  {_STRIP.format(_ROOM)} AS f03_strip, upper({_STRIP.format(_ROOM + " || 'b'")}) AS f04_number, p_name AS f05_use,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE upper(left(p_type, 1)) || lower(substr(p_type, 2)) END AS f06_type,
  array_to_string(list_sort(list_distinct(list_filter(string_split('the hall of ' || lower(p_name), ' '), lambda x: length(x) >= 2 AND x NOT IN ('the', 'hall', 'of')))), '|') AS f11_names,
  CASE WHEN p_size % 2 = 0 THEN 'B1 ' ELSE '' END || CASE WHEN p_size % 4 <> 0 THEN {_STRIP.format(_ROOM)} ELSE 'rm' || p_partkey END AS f36_title,
  CASE WHEN p_partkey % 5 = 0 THEN 'East door' WHEN p_partkey % 7 = 0 THEN 'Dock' WHEN p_size % 9 > 4 THEN 'North entrance' ELSE 'entrance' END AS f36_door
FROM part"""


def t01_search(spark: SparkSession, sf: str, query: str = QUERY) -> DataFrame:
    codes = [f"b{i}" for i in range(1, 26)]
    return S.search(_entries(spark, sf), query, codes, 20).select("id", "kind", "title", F.col("score").cast("long").alias("score"))


_PREFIX = "(CASE WHEN len(list_filter({w}, lambda x: starts_with(x, '{t}'))) = 0 THEN 0 WHEN list_filter({w}, lambda x: starts_with(x, '{t}'))[1] = '{t}' THEN 2 ELSE 1 END)"


def _points(tok: str) -> str:
    if tok.isdigit():
        return f"CASE WHEN num = '{tok}' THEN 60 WHEN starts_with(num, '{tok}') THEN 35 ELSE 0 END"
    w, b = _PREFIX.format(w="words", t=tok), _PREFIX.format(w="bwords", t=tok)
    return f"CASE WHEN {w} > 0 THEN 8 + 4 * {w} WHEN {b} > 0 THEN 3 ELSE 0 END"


def _search_sql(query: str, limit: str) -> str:
    toks = S.query_tokens(query)
    own = " OR ".join(f"(({_points(t)}) > 3)" for t in toks)
    dead = " OR ".join(f"(({_points(t)}) = 0)" for t in toks)
    bdead = " OR ".join(f"({_PREFIX.format(w='words', t=t)} = 0)" for t in toks)
    total, btotal = " + ".join(f"({_points(t)})" for t in toks), " + ".join(f"(30 + 5 * {_PREFIX.format(w='words', t=t)})" for t in toks)
    return f"""
WITH e AS (
  SELECT 'p' || p_partkey AS id, 'room' AS kind, 'B' || regexp_extract(p_brand, '(\\d+)', 1) || ' ' || p_partkey || ' ' || p_name AS title, CAST(p_partkey AS VARCHAR) AS num,
         string_split(p_name || ' ' || lower(p_type), ' ') AS words, ['brand', regexp_extract(p_brand, '(\\d+)', 1)] AS bwords FROM part
  UNION ALL SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1), 'building', replace(p_brand, '#', ' '), '', ['brand', regexp_extract(p_brand, '(\\d+)', 1)], [] FROM part),
f AS (SELECT id, kind, title, num, list_filter(words, lambda x: kind = 'room' OR length(x) >= 2) AS words, list_filter(bwords, lambda x: length(x) >= 2) AS bwords FROM e),
s AS (SELECT id, kind, title, CASE WHEN kind = 'room' THEN CASE WHEN ({dead}) OR NOT ({own}) THEN 0 ELSE {total} END ELSE CASE WHEN {bdead} THEN 0 ELSE {btotal} END END AS score FROM f)
SELECT id, kind, title, CAST(score AS BIGINT) AS score FROM s WHERE score > 0
ORDER BY score DESC, kind, CAST(regexp_extract(title, '(\\d+)', 1) AS INT), CASE WHEN kind = 'room' THEN CAST(substr(id, 2) AS INT) END, id {limit}"""


def f09_f10_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = _entries(spark, sf).withColumn("score", S.scores(S.query_tokens("brand red"), []))
    return e.where("score > 0").select("id", "kind", F.col("score").cast("long").alias("score"))


def f12_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts against names of benchmark-like phrases: the best phrase of each part by overlap."""
    p = table(spark, sf, "part").select("p_partkey", T.name_tokens(F.col("p_name")).alias("t"))
    sides = [T.name_tokens(F.lit(x)) for x in ("The Red Hall & Ring", "small widget", "of the and")]
    return p.select("p_partkey", *(T.name_similarity(F.col("t"), s).alias(f"sim{i}") for i, s in enumerate(sides)))


def f14_f20_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    flag = F.element_at(F.array(*map(F.lit, ["TRUE", "no", "", "1", "maybe"])), (k % 5 + 1).cast("int"))
    num = F.when(k % 3 == 0, F.concat(F.lit("-"), k.cast("string"), F.lit(".5"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("x"))).otherwise(k.cast("string"))
    area = F.concat(F.lit("approx 1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" SF"))
    circ = F.concat((k % 30).cast("string"), F.lit("00"), F.when(k % 2 == 0, "B").otherwise(""))
    return p.select(
        "p_partkey",
        T.to_bool(flag, True).alias("f14_bool"),
        T.truthy(flag).alias("f14_truthy"),
        T.number_of(num).alias("f16_number"),
        T.parse_area(area).alias("f17_area"),
        T.is_circulation_number(circ).alias("f19_circulation"),
        T.plan_asset_name(F.concat(F.lit("bld-"), k.cast("string"))).alias("f20_asset"),
        T.cell(k % 2 == 0, F.when(k % 4 == 0, F.lit("new")), F.lit("old")).alias("f15_cell"),
        T.access_class(F.element_at(F.array(*map(F.lit, ["ALT", "main", "odd", "Emergency"])), (k % 4 + 1).cast("int"))).alias("p09_access"),
        T.is_public(F.when(k % 3 == 0, "FALSE").when(k % 3 == 1, "x")).alias("p01_public"),
        T.canonical(F.create_map(F.lit("z"), F.col("p_name"), F.lit("a"), F.col("p_brand"))).alias("f13_canonical"),
    )


_PARSE = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN false ELSE true END AS f14_bool, p_partkey % 5 IN (0, 3) AS f14_truthy,
 CASE p_partkey % 3 WHEN 0 THEN CAST('-' || p_partkey || '.5' AS DOUBLE) WHEN 2 THEN CAST(p_partkey AS DOUBLE) END AS f16_number,
 CAST(1000 + p_partkey % 1000 AS DOUBLE) AS f17_area,
 regexp_full_match((p_partkey % 30) || '00' || CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE '' END, '\\d?\\d00[A-Z]?') AS f19_circulation,
 'FP_bld_' || p_partkey AS f20_asset, CASE WHEN p_partkey % 2 = 1 THEN 'old' WHEN p_partkey % 4 = 0 THEN 'new' END AS f15_cell,
 ['alt', 'main', 'main', 'emergency'][p_partkey % 4 + 1] AS p09_access, p_partkey % 3 <> 0 AS p01_public,
 '{"a":"' || p_brand || '","z":"' || p_name || '"}' AS f13_canonical FROM part"""


def f21_f23_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    params = T.query_params(T.query_part(F.col("url")))
    shared = F.concat(F.lit("https://x.org/"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("d/a_"), "page_id", F.lit("/view"))).otherwise(F.concat(F.lit("?id="), "page_id")))
    return p.select(
        "page_id",
        T.query_param(F.col("url"), "page").alias("f22_page"),
        F.try_element_at(params, F.lit("ref")).alias("f21_ref"),
        F.size(params).cast("long").alias("f21_n"),
        T.safe_link(F.concat("url", F.when(F.col("page_id") % 3 == 0, '" onclick=').otherwise(""))).alias("f26_link"),
        T.drive_direct_url(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(shared)).alias("f26_direct"),
        F.sha2(T.escape_html(F.col("html")), 256).alias("f27_escaped"),
        T.directions_url(F.col("page_id") % 90, F.col("page_id") % 180).alias("r30_directions"),
    )


_LINKS = """
WITH q AS (SELECT *, regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM pages),
r AS (SELECT *, list_filter(string_split(qs, '&'), lambda x: x <> '') AS ps FROM q)
SELECT page_id, CASE WHEN len(list_filter(ps, lambda x: starts_with(x, 'page='))) > 0 THEN substr(list_filter(ps, lambda x: starts_with(x, 'page='))[1], 6) END AS f22_page,
 CASE WHEN len(list_filter(ps, lambda x: starts_with(x, 'ref='))) > 0 THEN substr(list_filter(ps, lambda x: starts_with(x, 'ref='))[1], 5) END AS f21_ref,
 CAST(len(list_distinct(list_transform(ps, lambda x: string_split(x, '=')[1]))) AS BIGINT) AS f21_n, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS f26_link,
 CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 2 = 0 THEN 'https://drive.google.com/uc?export=view&id=a_' || page_id ELSE 'https://drive.google.com/uc?export=view&id=' || page_id END AS f26_direct,
 sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS f27_escaped,
 'https://www.google.com/maps/dir/?api=1&destination=' || (page_id % 90) || '%2C' || (page_id % 180) AS r30_directions FROM r"""


def f23_payload(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    code = T.encode_payload(F.col("props"))
    return e.select("event_id", code.alias("code"), T.decode_payload(code).alias("back"), T.parse_json(T.decode_payload(code), "k long", F.named_struct(F.lit("k"), F.lit(-1).cast("long")))["k"].alias("k"))


def f24_f39_clock(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    expires = F.when(F.col("event_id") % 4 == 0, "not a date").otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    said = T.event_label(F.col("event_type"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("a<b> "), "props")), ("click", "view"))
    return e.select(
        "event_id",
        T.format_time(F.date_format("t", "HH:mm")).alias("f24_time"),
        T.format_date(F.col("t")).alias("f25_date"),
        said["path"].alias("f30_path"),
        said["title"].alias("f30_title"),
        T.compass_side(F.col("value") * 10).alias("f32_side"),
        T.entrance_label(T.compass_side(F.col("value") * 10), F.col("user_id") % 3, F.col("user_id") % 4).alias("f33_label"),
        T.expired(F.col("event_id") % 3 == 0, expires, now).alias("f39_expired"),
        T.feature_id(F.when(F.col("event_id") % 2 == 0, F.col("event_id")), F.col("user_id")).alias("f34_id"),
        T.endpoint_for(F.when(F.col("event_id") % 3 == 0, "https://x.org").when(F.col("event_id") % 3 == 1, " My-site ").otherwise("NO!")).alias("f31_endpoint"),
        T.version_of(F.when(F.col("event_id") % 2 == 0, "bad version"), F.col("event_type")).alias("f29_version"),
    )


_SIDE = "['North', 'Northeast', 'East', 'Southeast', 'South', 'Southwest', 'West', 'Northwest'][CAST(floor(value * 10 / 45 + 0.5) AS BIGINT) % 8 + 1]"
_CLOCK = f"""
SELECT event_id, CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || ':' || strftime(ts, '%M') || CASE WHEN hour(ts) >= 12 THEN ' PM' ELSE ' AM' END AS f24_time,
 strftime(ts, '%A, %B ') || day(ts) || ', ' || year(ts) AS f25_date,
 CASE WHEN event_type IN ('click', 'view') THEN event_type END AS f30_path,
 CASE WHEN event_type IN ('click', 'view') THEN left(regexp_replace(CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'a<b> ' || props END, '[^a-zA-Z0-9_ .:-]', '', 'g'), 60) END AS f30_title,
 {_SIDE} AS f32_side,
 {_SIDE} || ' entrance' || CASE WHEN user_id % 3 > 1 THEN ' ' || user_id % 3 ELSE '' END || CASE WHEN user_id % 4 > 1 THEN ', level ' || user_id % 4 ELSE '' END AS f33_label,
 event_id % 3 <> 0 AND event_id % 4 <> 0 AND date_trunc('second', ts) < TIMESTAMP '2024-01-15' AS f39_expired,
 CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'override/' || user_id END AS f34_id,
 CASE event_id % 3 WHEN 0 THEN 'https://x.org' WHEN 1 THEN 'https://my-site.goatcounter.com/count' ELSE '' END AS f31_endpoint, event_type AS f29_version
FROM events"""


def p05_p18_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    when = lambda m, r, v: F.when(k % m == r, v)
    tags = {"highway": pick(["footway", "service", "steps", "motorway", "cycleway", "pedestrian"], k), "foot": when(7, 0, "no").when(k % 7 == 1, "yes"), "access": when(5, 0, "private")}
    tags |= {"service": when(11, 0, "drive-through"), "footway": when(13, 0, "crossing"), "area": when(17, 0, "yes"), "note": F.lit("")}
    tags = F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*tags.values()))
    kind = T.walk_kind(tags)
    other = pick(["parking", "water", "park", "grass", "pedestrian", "residential", "footway"], F.floor(k / 7))
    layer = T.first_layer(F.create_map(pick(["building", "highway", "leisure", "amenity", "waterway", "natural", "landuse"], k), other), k % 2 == 0, k % 4)
    base = T.base_layer(when(9, 0, "Green"), when(5, 0, "footways"), pick(["Point", "LineString", "Polygon", "MultiLineString"], k), other, k % 10 == 3)
    building, name = pick(["yes", "dormitory", "roof", "school"], k), F.when(k % 11 == 0, "Old College").otherwise("")
    sizes = F.map_from_arrays(F.array(*map(F.lit, ["height", "building:levels", "building"])), F.array(when(3, 0, "9"), when(2, 0, F.col("p_size").cast("string")), building))
    h = T.building_height(sizes, when(5, 0, "12,5"), when(7, 0, "3"), name)
    levels = T.default_levels(building, name)
    value = pick(["2.5", "0.5", "", "-1", "abc"], k)
    return p.select(
        "p_partkey",
        kind.alias("p05_walk"),
        T.path_kind(tags).alias("p06_kind"),
        T.path_access(kind).alias("p07_access"),
        T.auto_entrance_access(k % 2 == 0, pick(["stair", "lobby", "mechanical"], k)).alias("p08_access"),
        layer["layer"].alias("p10_layer"),
        layer["kind"].alias("p10_kind"),
        layer["shape"].alias("p10_shape"),
        base.alias("p11_layer"),
        F.concat_ws(",", F.map_keys(T.clean_map(tags))).alias("p12_clean"),
        F.concat_ws(",", F.map_keys(T.trim_tags(tags, "^(highway|foot)$"))).alias("p13_trim"),
        T.is_searchable(pick(["room", "chase"], k), pick(["corridor", "lab", "mechanical"], k)).alias("p14_searchable"),
        h["height"].alias("p15_height"),
        h["levels"].alias("p15_levels"),
        h["source"].alias("p15_source"),
        levels["levels"].alias("p16_levels"),
        levels["type"].alias("p16_type"),
        T.routing_number(value, 15.0, 0.0).alias("p17_weight"),
        T.routing_number(value, 3.0, 1.0, 1.0).alias("p17_factor"),
        T.routing_number(value, 8.0).alias("p18_config"),
    )


_RULES = """
WITH t AS (SELECT p_partkey, p_partkey AS k, p_size, ['footway', 'service', 'steps', 'motorway', 'cycleway', 'pedestrian'][p_partkey % 6 + 1] AS h,
  ['building', 'highway', 'leisure', 'amenity', 'waterway', 'natural', 'landuse'][p_partkey % 7 + 1] AS t, ['parking', 'water', 'park', 'grass', 'pedestrian', 'residential', 'footway'][p_partkey // 7 % 7 + 1] AS v,
  CASE WHEN p_partkey % 4 = 1 OR p_partkey % 11 = 0 THEN 4.0::DOUBLE WHEN p_partkey % 4 = 3 THEN 3 ELSE 2 END AS d, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS tl FROM part),
u AS (SELECT *, CASE WHEN h IN ('footway', 'cycleway') AND k % 13 = 0 THEN 'crossing' WHEN h IN ('footway', 'steps', 'pedestrian') THEN h WHEN h = 'cycleway' THEN 'path' END AS kind FROM t),
w AS (SELECT *, CASE WHEN k % 17 = 0 THEN NULL WHEN kind IS NOT NULL THEN kind WHEN h = 'service' AND k % 7 <> 0 AND (k % 5 <> 0 OR k % 7 = 1) AND k % 11 <> 0 THEN 'road' END AS walk,
  CASE WHEN k % 4 < 2 THEN NULL WHEN t = 'highway' AND v IN ('footway', 'pedestrian') THEN 'paths' WHEN t = 'highway' AND v = 'residential' THEN 'roads' WHEN k % 2 = 1 THEN CASE WHEN t = 'waterway' THEN 'water' END
    WHEN t = 'amenity' AND v = 'parking' THEN 'parking' WHEN t = 'natural' AND v = 'water' THEN 'water' WHEN (t = 'landuse' AND v = 'grass') OR (t = 'leisure' AND v = 'park') THEN 'landuse' END AS layer FROM u)
SELECT p_partkey, walk AS p05_walk, kind AS p06_kind, CASE WHEN walk = 'road' THEN 'alt' ELSE 'main' END AS p07_access,
 CASE WHEN k % 2 = 0 THEN 'main' WHEN k % 3 = 0 THEN 'emergency' ELSE 'alt' END AS p08_access,
 layer AS p10_layer, CASE WHEN layer IS NOT NULL THEN v END AS p10_kind, CASE WHEN layer IN ('paths', 'roads') OR (layer = 'water' AND t = 'waterway') THEN 'LineString' WHEN layer IS NOT NULL THEN 'Polygon' END AS p10_shape,
 CASE WHEN k % 9 = 0 THEN 'landuse' WHEN k % 5 = 0 THEN 'paths' WHEN k % 4 = 0 THEN 'labels' WHEN k % 2 = 1 THEN CASE WHEN v IN ('footway', 'pedestrian') OR k % 10 = 3 THEN 'paths' WHEN v = 'water' THEN 'water' ELSE 'roads' END WHEN v IN ('parking', 'water') THEN v ELSE 'landuse' END AS p11_layer,
 'highway' || CASE WHEN k % 7 < 2 THEN ',foot' ELSE '' END || CASE WHEN k % 5 = 0 THEN ',access' ELSE '' END || CASE WHEN k % 11 = 0 THEN ',service' ELSE '' END || CASE WHEN k % 13 = 0 THEN ',footway' ELSE '' END || CASE WHEN k % 17 = 0 THEN ',area' ELSE '' END AS p12_clean,
 'foot,highway' AS p13_trim, k % 2 = 0 AND k % 3 = 1 AS p14_searchable,
 CASE WHEN k % 5 = 0 THEN 12.5 WHEN k % 7 = 0 THEN 10.5 WHEN k % 3 = 0 THEN 9 WHEN tl > 0 THEN tl * 3.5 WHEN k % 4 = 2 THEN 4 ELSE d * 3.5 END::DOUBLE AS p15_height,
 CASE WHEN k % 5 = 0 THEN CASE WHEN k % 7 = 0 THEN 3 ELSE coalesce(tl, 4) END WHEN k % 7 = 0 THEN 3 WHEN k % 3 = 0 THEN coalesce(tl, 3) WHEN tl > 0 THEN tl WHEN k % 4 = 2 THEN 1 ELSE d END::DOUBLE AS p15_levels,
 CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'override' WHEN k % 3 = 0 OR tl > 0 THEN 'osm' ELSE 'default' END AS p15_source, d AS p16_levels, CASE d WHEN 4 THEN 'residence' WHEN 3 THEN 'academic' ELSE 'other' END AS p16_type,
 [2.5, 0.5, 15, 15, 15][k % 5 + 1]::DOUBLE AS p17_weight, [2.5, 1, 3, 1, 3][k % 5 + 1]::DOUBLE AS p17_factor, [2.5, 0.5, 8, -1, 8][k % 5 + 1]::DOUBLE AS p18_config FROM w"""

QUERIES = {
    "t01_search": t01_search,
    "f01_f06_forms": f01_f06_forms,
    "f09_f10_scores": f09_f10_scores,
    "f12_names": f12_names,
    "f14_f20_parse": f14_f20_parse,
    "f21_f27_links": f21_f23_links,
    "f23_payload": f23_payload,
    "f24_f39_clock": f24_f39_clock,
    "p05_p18_rules": p05_p18_rules,
}
ORACLE = {
    "t01_search": f"SELECT * FROM ({_search_sql(QUERY, 'LIMIT 20')})",
    "f01_f06_forms": _FORMS,
    "f09_f10_scores": f"SELECT id, kind, score FROM ({_search_sql('brand red', '')})",
    "f12_names": "WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS t FROM part) SELECT p_partkey, CAST(len(list_intersect(t, ['red', 'ring'])) AS DOUBLE) / least(2, len(t)) AS sim0, CAST(len(list_intersect(t, ['small', 'widget'])) AS DOUBLE) / least(2, len(t)) AS sim1, CAST(0 AS DOUBLE) AS sim2 FROM w",
    "f14_f20_parse": _PARSE,
    "f21_f27_links": _LINKS,
    "f23_payload": "SELECT event_id, url_encode(base64(encode(props))) AS code, props AS back, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events",
    "f24_f39_clock": _CLOCK,
    "p05_p18_rules": _RULES,
}
