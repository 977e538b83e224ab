"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs: the sentences of its lines, trimmed, without empty ones. Each is
hashed to a wide vector, and the fingerprint is the sum of the vectors modulo powers of two, so it does not
depend on order, and a paragraph is inserted or deleted by adding or subtracting its vector (`combine`).

The vector of a paragraph has
- 126 narrow lanes, bits of two XXH64 hashes; 42 longs hold three lanes each, 21 bits apart, which are added modulo
  2^20 (the bit between takes the carry and is cleared),
- two wide lanes of 62 bits of two more hashes, added modulo 2^62, which set unequal multisets apart, and
- a count of paragraphs.
The four hashes are of separately salted texts, so none follows from another.

With n paragraphs a narrow lane's sum c gives 2c - n, a sum of +1 and -1 (exact while it is below 2^20). The product
of two texts' lanes estimates how many paragraphs they share (counted with multiplicity), so the cosine estimates
likeness with a standard error of about 1/11; it is clipped to 0..1.

Everything is made of DataFrame functions, and a fingerprint is computed inside its row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.llm.common import bucket_of, pick, text_key

FIELD, FIELDS, HASHES = 21, 3, ("h", "i")
_ONES = sum(1 << FIELD * k for k in range(FIELDS))
_LANES = _ONES * ((1 << FIELD - 1) - 1)
_WIDE = (1 << 62) - 1
#: Characters of text in a range of documents, which one task sorts.
RANGE_CHARS = 16_000_000
#: Ends of paragraphs: line feeds, and full stops, question and exclamation marks before white space.
PARAGRAPH_END = r"\n+|(?<=[.!?])\s+"


def paragraphs(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), F.trim), "")


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with column `name`: the vector struct(lanes, a, b, n) of the text column; null counts as empty."""
    salted = {"h": "", "i": "i", "a": "a", "b": "b"}
    keys = F.transform(paragraphs(F.col(text)), lambda p: F.struct(*(F.xxhash64(F.concat(F.lit(salt), p) if salt else p).alias(f) for f, salt in salted.items())))
    df, k = df.withColumn("__keys", keys), F.col("__keys")
    zero, lanes = F.lit(0).cast("long"), F.lit(_LANES)

    def lane(f: str, g: int) -> Column:
        return F.aggregate(k, zero, lambda s, x: (s + F.shiftrightunsigned(x[f], g).bitwiseAND(F.lit(_ONES))).bitwiseAND(lanes))

    def wide(f: str) -> Column:
        return F.aggregate(k, zero, lambda s, x: _mod(s + x[f].bitwiseAND(F.lit(_WIDE))))

    v = F.struct(F.array(*(lane(f, g) for f in HASHES for g in range(FIELD))).alias("lanes"), wide("a").alias("a"), wide("b").alias("b"), F.size(k).cast("long").alias("n"))
    return df.withColumn(name, v).drop("__keys")


def _mod(x: Column) -> Column:
    """Modulo 2^62; two such numbers add up without overflow."""
    return x.bitwiseAND(F.lit(_WIDE))


def combine(v: Column, w: Column, sign: int = 1) -> Column:
    """The vector of the union of two multisets (sign 1), or of the first without the second (sign -1)."""
    guard = F.lit(_ONES << FIELD - 1)

    def fields(x: Column, y: Column) -> Column:
        # a set bit between the fields lends to the one below it, so a difference wraps within its field
        return (x + y if sign > 0 else x.bitwiseOR(guard) - y).bitwiseAND(F.lit(_LANES))

    def wide(x: Column, y: Column) -> Column:
        return _mod(x + y if sign > 0 else x - y)

    return F.struct(F.zip_with(v["lanes"], w["lanes"], fields).alias("lanes"), wide(v["a"], w["a"]).alias("a"), wide(v["b"], w["b"]).alias("b"), (v["n"] + F.lit(sign) * w["n"]).alias("n"))


def digits(v: Column) -> Column:
    """The vector as lower-case hex digits: 16 a long."""

    def text(x: Column) -> Column:
        return F.lpad(F.hex(x), 16, "0")

    return F.lower(F.concat(F.array_join(F.transform(v["lanes"], text), ""), text(v["a"]), text(v["b"]), text(v["n"])))


def signs(v: Column) -> Column:
    """The narrow lanes as sums of +1 and -1, as doubles."""

    def field(x: Column, k: int) -> Column:
        twice = F.shiftright(x, FIELD * k).bitwiseAND(F.lit((1 << FIELD - 1) - 1)) * 2 - v["n"]
        return (F.pmod(twice + (1 << FIELD - 1), F.lit(1 << FIELD)) - (1 << FIELD - 1)).cast("double")

    return F.flatten(F.transform(v["lanes"], lambda x: F.array(*(field(x, k) for k in range(FIELDS)))))


def likeness(v: Column, w: Column) -> Column:
    """0 to 1: 1 for equal multisets (two empty ones too), 0 if only one is empty, else the clipped cosine."""
    s, t = signs(v), signs(w)
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: i * j), zero, lambda acc, z: acc + z)

    norm = F.sqrt(dot(s, s) * dot(t, t))
    return F.when(v == w, 1.0).when((norm == 0) | (v["n"] == 0) | (w["n"] == 0), 0.0).otherwise(F.greatest(zero, F.least(F.lit(1.0), dot(s, t) / norm)))


def in_ranges(rows: DataFrame, key: str, parts: int, at_once: int = 1_000) -> Column:
    """About `parts` ranges of `key` of as many rows each, as a whole number that grows with the key.

    Beyond `at_once` parts each of as many outer ranges is parted by the mean spacing of its keys, so the plan holds
    no more cuts than that.
    """
    outer = min(parts, at_once)
    points = [i / outer for i in range(outer + 1)]
    cuts = rows.agg(F.percentile_approx(key, points, max(10_000, 10 * outer)).alias("q")).first().q if parts > 1 else None
    if not cuts:
        return F.lit(0)
    at = bucket_of(F.col(key), sorted(set(cuts[1:-1])))
    if parts <= at_once:
        return at
    inner = -(-parts // outer)
    edges = F.array(*map(F.lit, [cuts[0], *sorted(set(cuts[1:-1])), cuts[-1]]))
    lo, hi = F.get(edges, at), F.get(edges, at + 1)
    share = F.floor((F.col(key) - lo) * inner / F.greatest(hi - lo + 1, F.lit(1)))
    return at.cast("long") * inner + F.greatest(F.lit(0), F.least(F.lit(inner - 1), share))


def with_next(rows: DataFrame, key: str, value: str, parts: int) -> DataFrame:
    """`rows` (distinct column names) with column `next`: `value` of the row that follows by descending `key`.

    After the last row comes the first; a sole row follows itself. Null keys come last; rows that share a
    key are ordered by `value`'s digest column tkey. The rows of one key, null too, are in one range. Rows are dealt to about `parts` ranges of the key, a
    range is sorted within its task, and only the first row of each range is fetched for the range before, by a
    broadcast of `parts` + 2 keys.
    """
    rows = rows.withColumn("__b", F.when(F.col(key).isNull(), -1).otherwise(in_ranges(rows, key, parts)))
    # of each range the first row: by key and digest alone, then its value by a join with those few rows
    lead = F.struct(F.col(key).alias("k"), F.col("tkey").alias("t"))
    tops = rows.groupBy("__b").agg(F.max(lead).alias("top"))
    after = W.orderBy(F.col("__b").desc())
    follows = F.coalesce(F.lead("top").over(after), F.first("top").over(after.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    tops = tops.select("__b", follows.alias("f")).select(F.col("__b").alias("__of"), F.col("f.k").alias("__k"), F.col("f.t").alias("__t"))
    first = rows.select(F.col(key).alias("__key"), F.col("tkey").alias("__tkey"), F.col(value).alias("__first"))
    first = F.broadcast(tops).join(first, F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__t") == F.col("__tkey")))
    first = first.groupBy("__of").agg(F.first("__first").alias("__first"))
    w = W.partitionBy("__b").orderBy(F.col(key).desc_nulls_last(), F.col("tkey").desc())
    led = rows.withColumn("__lead", F.lead(value).over(w)).withColumn("__last", F.row_number().over(w) == F.count("*").over(W.partitionBy("__b")))
    out = led.join(first, F.col("__b") == F.col("__of"), "left")
    return out.withColumn("next", F.when(F.col("__last"), F.col("__first")).otherwise(F.col("__lead"))).drop("__b", "__lead", "__last", "__of", "__first")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited, v, edited_v, next_v) for every row of `docs`.

    edited is the text whose last floor(n_chars / 2) code points give way to as many first ones of the
    next document's text (all of it if it has fewer), by descending id; see with_next for ties and nulls.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, -(-int(d.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE_CHARS))
    d = with_vector(d, "text", "v").select("doc_id", text_key(F.col("text")).alias("tkey"), "v", F.struct("text", "v").alias("own"))
    d = with_next(d.select("doc_id", "tkey", "own"), "doc_id", "own", parts)
    d = d.select("doc_id", F.col("own.text").alias("text"), F.col("own.v").alias("v"), F.col("next.text").alias("after"), F.col("next.v").alias("next_v"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.left("text", n - half), F.left("after", half))).withColumn("n_chars", n.cast("long"))
    return with_vector(d, "edited", "edited_v").select("doc_id", "n_chars", "edited", "v", "edited_v", "next_v")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with likenesses; null texts are empty, see edited_pairs."""
    p = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    v, e = F.col("v"), F.col("edited_v")
    return p.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(v).alias("fingerprint"),
        digits(e).alias("edited_fingerprint"),
        likeness(v, e).alias("near_edited"),
        likeness(v, F.col("next_v")).alias("near_next"),
    )


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLE: dict[str, str] = {}
