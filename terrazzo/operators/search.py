"""Ranked token search over a denormalised index.

An entry has id, kind ('room' or 'building'), title, code, num, words and bwords (the building's words). The score
is one fold over the query's tokens inside the row; a token that matches nothing makes it 0. One stage reads the
entries, and the best `limit` are kept per task before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions import text as T


def natural_key(title: Column) -> Column:
    """A sort key under which digit runs compare as numbers: each becomes a zero-padded run of 20 digits.

    Titles must not mix digits and other signs at one place, where the order by parts isn't transitive.
    Runs that differ only in leading zeros compare as equal.
    """
    parts = F.regexp_extract_all(F.lower(T.text(title)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p))


def build_index(rooms: DataFrame, buildings: DataFrame) -> DataFrame:
    """entries of rooms (id, number, label, type, building_id) and buildings (id, name, code), unioned."""
    b = buildings.select(F.col("id").alias("building_id"), F.lower(T.text(F.col("code"))).alias("code"), T.name_tokens(F.col("name"), ()).alias("bwords"), F.col("name").alias("bname"))
    words = F.array_distinct(F.concat(T.tokens(F.col("label")), T.tokens(F.col("type"))))
    num = F.lower(T.display_number(F.col("number")))
    parts = (F.upper(F.col("code")), T.display_number(F.col("number")), T.use_text(F.col("label"), F.col("number")))
    title = F.concat_ws(" ", *map(T.blank_to_null, parts))
    r = rooms.join(b, "building_id", "left")
    out = r.select("id", F.lit("room").alias("kind"), title.alias("title"), F.col("bname").alias("subtitle"), F.coalesce("code", F.lit("")).alias("code"), num.alias("num"), words.alias("words"), F.coalesce("bwords", F.array().cast("array<string>")).alias("bwords"))
    own = b.select(F.col("building_id").alias("id"), F.lit("building").alias("kind"), F.col("bname").alias("title"), F.lit(None).cast("string").alias("subtitle"), "code", F.lit("").alias("num"), F.col("bwords").alias("words"), F.array().cast("array<string>").alias("bwords"))
    return out.unionByName(own)


def score_room(query: list[str], code: Column, num: Column, words: Column, bwords: Column, codes: Column) -> Column:
    """F09, as one expression: each token adds its points, any miss or another building's code gives 0."""
    dead, own, total = F.lit(False), F.lit(False), F.lit(0)
    for tok in query:
        t = F.lit(tok)
        w, bw = T.prefix_of_any(t, words), T.prefix_of_any(t, bwords)
        is_code = (code != "") & (code == t)
        other = ~is_code & F.array_contains(codes, t)
        if tok[:1].isdigit():
            points = F.when(num == t, 60).when(F.startswith(num, t), 35).otherwise(0)
            hit = points > 0
        else:
            points = F.when(w > 0, 8 + 4 * w).when(bw > 0, 3).otherwise(0)
            hit = w > 0
        points = F.when(is_code, 25).when(other, 0).otherwise(points)
        dead = dead | (points == 0)
        own = own | (hit & ~is_code & ~other)
        total = total + points
    return F.when(dead | ~own, 0).otherwise(total)


def score_building(query: list[str], code: Column, words: Column) -> Column:
    """F10."""
    dead, total = F.lit(False), F.lit(0)
    for tok in query:
        w = T.prefix_of_any(F.lit(tok), words)
        points = F.when((code != "") & (code == tok), 70).when(w > 0, 30 + 5 * w).otherwise(0)
        dead, total = dead | (points == 0), total + points
    return F.when(dead, 0).otherwise(total)


def query_tokens(query: str) -> list[str]:
    """F02 of a query text that is at hand on the driver."""
    import re

    n = re.sub("[^a-z0-9]+", " ", query.lower().replace("&", " and ")).strip()
    return [re.sub(r"^0+(?=\d)", "", t) for t in re.sub(r"([a-z])(\d)", r"\1 \2", n).split()]


def search(entries: DataFrame, query: str, codes: list[str], limit: int = 8) -> DataFrame:
    """The best entries with their score: by score, buildings first, then natural title order and id.

    A query without tokens finds nothing.
    """
    q = query_tokens(query)
    scored = entries.withColumn("score", scores(q, codes) if q else F.lit(0)).where(F.col("score") > 0)
    order = [F.col("score").desc(), F.when(F.col("kind") == "building", 0).otherwise(1), natural_key(F.col("title")), F.col("id")]
    return scored.orderBy(*order).limit(limit)


def scores(query: list[str], codes: list[str]) -> Column:
    c = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")
    room = score_room(query, F.col("code"), F.col("num"), F.col("words"), F.col("bwords"), c)
    return F.when(F.col("kind") == "room", room).otherwise(score_building(query, F.col("code"), F.col("words")))
