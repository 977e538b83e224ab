"""Readers and writers: change files, feature collections, element extracts, listings and guarded writes.

Paths are opened by Spark and its file systems alone, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrazzo.functions import geo as G
from terrazzo.operators.merge import numbered

FEATURE = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
FEATURES = "type string, features array<struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
ELEMENT = "type string, id long, lat double, lon double, nodes array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"


#: So many lines, some 50 to 100 MB of records, are one task's part of a text.
PART_LINES = 500_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records, one a row, with `ord`, the place in the file; no file is an empty table.

    A file that isn't JSON stops the read with an error that names it. Files with a record a line are read in parts.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, ord long")
    parts = read_by_lines(spark, path, schema, lambda v: v == [])
    if parts is not None:
        return parts.select("r.*", "ord")
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("ord", F.monotonically_increasing_id())  # a file that spans lines is one partition


def read_by_lines(spark: SparkSession, path: str, schema: str, empty: Callable[[object], bool]) -> DataFrame | None:
    """(ord, r): the records of one JSON text that has each of them on a line of its own between a first and a last
    line, as `lines` makes it; None for any other text.

    Any number of tasks reads the text, in one file or in several that follow each other in the order of their names.
    Before that, one pass over all lines checks that the text has that shape: each line between the two is one
    record that fits the schema, all but the last end in a comma, and the first and last line alone are JSON that
    `empty` holds for.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    line = F.rtrim("value")
    comma = line.endswith(",")
    wrapped = F.concat(F.lit('{"r":['), F.when(comma, F.left(line, F.length(line) - 1)).otherwise(line), F.lit("]}"))
    read = F.from_json(wrapped, f"r array<struct<{_fields(schema)}>>, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    t = t.withColumns({"comma": comma, "j": read}).withColumn("ok", F.coalesce(F.col("j.__bad").isNull() & (F.size("j.r") == 1) & F.get("j.r", F.lit(0)).isNotNull(), F.lit(False)))
    place, short = F.struct("file", "start", "id"), F.left("value", F.lit(10_000))
    seen = F.col("ok")
    c = t.agg(
        F.count("*").alias("n"), F.count_if(~seen).alias("other"), F.min(F.struct(place, short.alias("v"), seen.alias("ok"))).alias("first"), F.max(F.struct(place, short.alias("v"), seen.alias("ok"))).alias("last"),
        F.count_if(seen & ~F.col("comma")).alias("open"), F.max(F.when(seen, place)).alias("end"), F.max(F.when(seen & ~F.col("comma"), place)).alias("end_open"),
    ).first()
    if c.n < 2 or c.other != 2 or c["first"].ok or c["last"].ok or c.open != min(1, c.n - 2) or c.end != c.end_open:
        return None
    try:
        if not empty(json.loads(c["first"].v + c["last"].v)):
            return None
    except ValueError:
        return None
    # a block's lines are numbered without gaps; what lies before it is one row a block
    blocks = t.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    w = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("least")).alias("shift"))
    rows = t.where("ok").select("file", "start", "id", F.get("j.r", F.lit(0)).alias("r"))
    return rows.join(F.broadcast(blocks), ["file", "start"]).select((F.col("id") + F.col("shift") - 1).alias("ord"), "r")


def _fields(schema: str) -> str:
    """A schema's columns as fields of a struct."""
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def read_folder(spark: SparkSession, folder: str, schema: str, keep: Column) -> DataFrame:
    """The JSON documents of a folder, one a file, with `file`; those that `keep` holds for."""
    df = spark.read.schema(schema).option("multiLine", True).json(folder)
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(keep)


def read_catalog(spark: SparkSession, folder: str, names: dict[str, str]) -> dict[str, DataFrame | None]:
    """The Parquet tables of a folder by name; None for those that aren't there."""
    return {name: spark.read.parquet(f"{folder}/{file}") if exists(spark, f"{folder}/{file}") else None for name, file in names.items()}


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, id, kind, properties, coordinates as JSON text) of a feature collection; in parts if it has a feature a line."""
    f = read_by_lines(spark, path, FEATURE, lambda v: isinstance(v, dict) and v.get("features") == [])
    if f is None:
        f = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "r"))
    f = f.withColumnRenamed("r", "f")
    return f.select("ord", F.coalesce("f.id", F.concat(F.lit("override/"), F.col("ord").cast("string"))).alias("id"), F.col("f.geometry.type").alias("kind"), F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("coordinates"))


def points_of(features: DataFrame) -> DataFrame:
    """The Point features with two finite numbers: (id, properties, lng, lat)."""
    xy = F.from_json("coordinates", "array<double>")
    p = features.where("kind = 'Point'").select("id", "properties", F.get(xy, F.lit(0)).alias("lng"), F.get(xy, F.lit(1)).alias("lat"))
    return p.where("lng is not null and lat is not null")


def feature(kind: Column, coordinates: Column, properties: Column) -> Column:
    """One feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def lines(df: DataFrame, order: str, json: Column, head: str = "[", tail: str = "]", indent: str = "  ") -> DataFrame:
    """Rows (n, line): `json` of each row on its line, in order, between head and tail.

    Lines are numbered by ranges, not in one task. An empty table is one line of head and tail.
    """
    spark = df.sparkSession
    rows = df.select(F.col(order).alias("__o"), json.alias("__json"))
    count = rows.count()
    if not count:
        return spark.createDataFrame([(0, head + tail)], "n long, line string")
    each = numbered(rows, "__o").select(F.col("__row").cast("long").alias("n"), F.concat(F.lit(indent), F.col("__json"), F.when(F.col("__row") < count, ",").otherwise("")).alias("line"))
    return each.unionByName(spark.createDataFrame([(0, head), (count + 1, tail)], "n long, line string"))


def write_lines(text: DataFrame, path: str, parts: int | None = None) -> None:
    """The lines in order as text, in as many parts as named, else one for each PART_LINES lines, in the order of their names."""
    parts = parts or max(1, -(-text.count() // PART_LINES))
    spread = text.repartition(1) if parts == 1 else text.repartitionByRange(parts, "n")
    spread.sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)


def digest(df: DataFrame) -> str:
    """What tables of the same rows share in whatever order: their number, and two sums of their hashes."""
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(F.concat(F.lit(salt), row)).cast("decimal(20,0)")), F.lit(0)).cast("string") for salt in ("", "b")]
    return df.agg(F.concat_ws("/", F.count("*").cast("string"), *sums).alias("d")).first().d


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write `df` as Parquet unless the table there has the same rows; the old one stays until the new is whole.

    The rows' digest lies beside the table, and the new files come in by a rename.
    """
    spark = df.sparkSession
    version = digest(df)
    mark = f"{path}.version"
    if exists(spark, path) and exists(spark, mark) and spark.read.text(mark).first()[0] == version:
        return False
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    target, fs = _fs(spark, path)
    fs.delete(target, True)
    if not fs.rename(_fs(spark, new)[0], target):
        raise OSError(f"{new} can't be renamed to {path}")
    spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(mark)
    return True


def flatten(df: DataFrame, by: list[str], children: str, names: list[str]) -> DataFrame:
    """The nested rows of each parent, with the parent's columns and their place."""
    return df.select(*by, F.posexplode(children).alias("pos", "__c")).select(*by, "pos", *(F.col("__c")[n].alias(n) for n in names))


def tiles(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """The map tiles (box, zoom, x, y) that cover each box (box, west, south, east, north)."""
    out = None
    for z in zooms:
        x0, y0 = G.tile(F.col("north"), F.col("west"), z)
        x1, y1 = G.tile(F.col("south"), F.col("east"), z)
        t = boxes.select("box", F.lit(z).alias("zoom"), F.explode(F.sequence(F.floor(x0).cast("long"), F.floor(x1).cast("long"))).alias("x"), F.floor(y0).cast("long").alias("__a"), F.floor(y1).cast("long").alias("__b"))
        t = t.select("box", "zoom", "x", F.explode(F.sequence("__a", "__b")).alias("y"))
        out = t if out is None else out.unionByName(t)
    return out


def split_box(boxes: DataFrame) -> DataFrame:
    """The four quarters of each box, with `quarter` 0..3 from the south-west."""
    mx, my = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    box = lambda q, w, s, e, n: F.struct(F.lit(q).alias("quarter"), w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    w, s, e, n = map(F.col, ("west", "south", "east", "north"))
    return boxes.select("box", F.explode(F.array(box(0, w, s, mx, my), box(1, mx, s, e, my), box(2, w, my, mx, n), box(3, mx, my, e, n))).alias("b")).select("box", "b.*")


def plan_load(cached: Column, remote: Column, failed: Column) -> Column:
    """`fetch` without a cached version or with another one there, `stale` if that can't be told, else `cache`."""
    return F.when(cached.isNull() & ~failed, "fetch").when(cached.isNull(), "none").when(failed | remote.isNull(), "stale").when(cached == remote, "cache").otherwise("fetch")


def extract(elements: DataFrame, wanted: Column, spare_node: Column) -> DataFrame:
    """Of elements (ELEMENT) the wanted ways and multipolygon relations, their member ways, and the nodes
    of those ways or that `spare_node` holds for. Coordinates keep seven digits."""
    ways, relations = elements.where(F.col("type") == "way"), elements.where((F.col("type") == "relation") & (F.try_element_at("tags", F.lit("type")) == "multipolygon") & wanted)
    members = relations.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id"))
    need = ways.where(wanted).select("id").unionByName(members).distinct()
    kept = ways.join(need, "id", "left_semi")
    refs = kept.select(F.explode("nodes").alias("id")).distinct().withColumn("__need", F.lit(True))
    nodes = elements.where(F.col("type") == "node").join(refs, "id", "left").where(F.coalesce("__need", spare_node, F.lit(False))).drop("__need")
    nodes = nodes.withColumns({c: F.round(c, 7) for c in ("lat", "lon")})
    return nodes.select(*elements.columns).unionByName(kept.select(*elements.columns)).unionByName(relations)


def way_coords(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, ring, closed): each way's points in order; nodes that aren't there are left out.

    closed: four references or more, of which the last is the first.
    """
    closed = (F.size("nodes") >= 4) & (F.element_at("nodes", 1) == F.element_at("nodes", -1))
    ref = ways.select("id", closed.alias("closed"), F.posexplode("nodes").alias("pos", "node"))
    at = ref.join(nodes.select(F.col("id").alias("node"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")), "node")
    got = at.groupBy("id").agg(F.first("closed").alias("closed"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("ring"))
    return got.select("id", "ring", "closed")


def outer_rings(relations: DataFrame) -> DataFrame:
    """(id, rings): the closed rings that each relation's outer ways, arrays of node ids, chain up to.

    relations: id, ways array<array<long>>. Ways that never close are left out; a ring starts with the first
    open way and takes the first that fits, either way round. A relation's ways are one row.
    """

    def chained(ways) -> list[list[int]]:
        rest, out = [list(map(int, w)) for w in ways if w is not None and len(w) > 1], []
        while rest:
            ring = rest.pop(0)
            while ring[0] != ring[-1]:
                for i, w in enumerate(rest):
                    if ring[-1] in (w[0], w[-1]):
                        ring += (w if w[0] == ring[-1] else w[::-1])[1:]
                        del rest[i]
                        break
                else:
                    break
            if ring[0] == ring[-1] and len(ring) >= 4:
                out.append(ring)
        return out

    def run(batches):
        for b in batches:
            yield b.assign(rings=[chained(w) for w in b["ways"]])[["id", "rings"]]

    return relations.select("id", "ways").mapInPandas(run, "id long, rings array<array<long>>")


def last_of(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The columns of each key's last row by `order`."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("l")).select(key, "l.*")


def nested(df: DataFrame, by: list[str], order: str, columns: list[str], name: str) -> DataFrame:
    """Children as an ordered array of structs beside their parent's key."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias(name))


def first_not_blank(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def ranked_floors(floors: DataFrame, building: str, level: str) -> DataFrame:
    """Floors with `storey`, their place from the lowest in their building, ties by nothing else."""
    return floors.withColumn("storey", F.dense_rank().over(W.partitionBy(building).orderBy(level)) - 1)
