import hashlib
import re

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from terrazzo.llm import multiset_hash as m


def brute(text):
    parts = [p.strip(" ") for p in re.split(r"\n+|(?<=[.!?])\s+", text)]
    parts = [p for p in parts if p]
    lanes = [0] * 42
    for p in parts:
        for k, salt in enumerate(("", "i")):
            h = xxh64_intdigest((salt + p).encode(), 42)
            for g in range(21):
                for f in range(3):
                    # the three lanes of a long, each for itself modulo 2^20
                    x = lanes[21 * k + g]
                    c = ((x >> 21 * f) + (h >> g + 21 * f & 1)) & (1 << 20) - 1
                    lanes[21 * k + g] = x & ~(((1 << 21) - 1) << 21 * f) | c << 21 * f
    return lanes, len(parts)


ROWS = [(5, "One. Two three.\nFour"), (4, "One. Two three. Five"), (3, None), (2, ""), (2, "é ü ß. x"), (9, "a"), (None, "Null id. One."), (1, "Four\nOne. Two three.")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, v string")


def test_against_brute_force(spark):
    got = m.edited_pairs(frame(spark)).collect()
    digest = lambda t: hashlib.md5((t or "").encode()).digest()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])), reverse=True)
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want.append((i, t[: len(t) - half] + after[:half], *brute(t)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited, r.v.lanes, r.v.n)) for r in got)


def test_order_does_not_matter_and_updates_match(spark):
    df = m.with_vector(frame(spark), "text", "w")
    v = {r.doc_id: r.d for r in df.where("doc_id in (5, 1)").select("doc_id", m.digits(F.col("w")).alias("d")).collect()}
    assert v[5] == v[1]
    one = spark.createDataFrame([("One. Two three.\nFour", "Four", "One. Two three.")], "x string, y string, z string")
    for c in "xyz":
        one = m.with_vector(one, c, "v" + c)
    r = one.select(
        (m.digits(m.combine(F.col("vy"), F.col("vz"))) == m.digits(F.col("vx"))).alias("p"),
        (m.digits(m.combine(F.col("vx"), F.col("vy"), -1)) == m.digits(F.col("vz"))).alias("q"),
        m.likeness(F.col("vx"), F.col("vx")).alias("same"),
    ).first()
    assert r.p and r.q and r.same == 1.0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_next_over_ranges(spark, parts):
    rows = spark.range(50).select((F.col("id") * 7 % 53).alias("k")).select("k", F.md5(F.col("k").cast("string")).alias("tkey"), F.col("k").alias("val"))
    got = {r.k: r.next for r in m.with_next(rows, "k", "val", parts).collect()}
    ids = sorted(got, reverse=True)
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_ranges_of_ranges(spark):
    rows = spark.range(200).select((F.col("id") * F.col("id")).alias("k"))
    got = sorted((r.k, r.b) for r in rows.withColumn("b", m.in_ranges(rows, "k", 60, 7)).collect())
    b = [x for _, x in got]
    assert b == sorted(b) and len(set(b)) > 30


def test_empty_table(spark):
    assert m.edited_pairs(frame(spark, [])).count() == 0


def test_fields_never_carry(spark):
    """Sums pass 2^20 and differences fall below 0 without touching the neighbouring field."""
    top = (1 << 20) - 1
    rows = [([top | 3 << 21 | top << 42], [1 | 4 << 21 | 2 << 42])]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>")
    v = lambda c: F.struct(F.col(c).alias("lanes"), F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"), F.lit(1).cast("long").alias("n"))
    r = df.select(m.combine(v("x"), v("y")).alias("p"), m.combine(v("x"), v("y"), -1).alias("q")).first()
    assert r.p.lanes == [0 | 7 << 21 | 1 << 42] and r.q.lanes == [top - 1 | top << 21 | (top - 2) << 42]


def test_likeness_estimates_shared_paragraphs(spark):
    """Against the share that is true: the mean error is small and single ones stay within four standard errors."""
    rows = [(k, " ".join(f"s{k}x{i}." for i in range(40)), " ".join(f"s{k}x{i if i < k else -i}." for i in range(40))) for k in range(0, 41, 2)]
    df = m.with_vector(m.with_vector(spark.createDataFrame(rows, "k int, a string, b string"), "a", "v"), "b", "w")
    got = df.select("k", m.likeness(F.col("v"), F.col("w")).alias("s")).collect()
    errors = [r.s - r.k / 40 for r in got]
    assert max(map(abs, errors)) < 4 / 126**0.5 and abs(sum(errors) / len(errors)) < 0.06
    h, a = zip(*[(xxh64_intdigest(f"p{i}".encode(), 42), xxh64_intdigest(f"ap{i}".encode(), 42)) for i in range(2000)])
    agree = sum((x ^ y).bit_count() for x, y in zip(h, a)) / 64 / 2000
    assert abs(agree - 0.5) < 0.01
