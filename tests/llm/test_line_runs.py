import random

import pytest

from terrazzo.llm import line_runs as r


def brute(rows, min_lines, min_words):
    """Every run of any length against its first earlier place; what overlaps that place stays."""
    docs = sorted((x for x in rows if x[1] is not None), key=lambda x: (x[0] is None, x[0] or 0))
    seq = [t.split("\n") for _, t in docs]
    gone = [set() for _ in seq]
    at = [(d, p) for d, s in enumerate(seq) for p in range(len(s))]
    for i, (d, p) in enumerate(at):
        same, n = at[:i], 0
        while p + n < len(seq[d]):
            same = [(e, q) for e, q in same if q + n < len(seq[e]) and seq[d][p + n] == seq[e][q + n]]
            n += 1
            if not same:
                break
            if n >= min_lines or sum(x.count(" ") + 1 for x in seq[d][p : p + n]) >= min_words:
                e, q = same[0]
                gone[d] |= set(range(p, p + n)) - (set(range(q, q + n)) if e == d else set())
    return sorted((str(i), "\n".join(x for k, x in enumerate(s) if k not in g), len(g)) for (i, _), s, g in zip(docs, seq, gone))


@pytest.mark.parametrize("min_lines,min_words", [(3, 8), (5, 1000), (1, 1), (4, 6)])
def test_against_brute_force(spark, min_lines, min_words):
    rnd = random.Random(min_lines)
    pool = ["a", "b b", "c c c", "", "d d d d d d d d d", "e e e e"]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.8 else f"u{i}{rnd.random()}" for _ in range(rnd.randrange(1, 9)))) for i in range(25)]
    rows += [(90, None), (91, ""), (92, "long " * 3000), (93, rows[3][1]), (94, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, a string, pos int")
    out = r.dedup_lines(df, min_lines=min_lines, min_words=min_words)
    assert out.columns[:4] == df.columns
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted((str(x.doc_id), x.text, x["__n_removed"]) for x in got if x.text is not None) == brute(rows, min_lines, min_words)
    assert [(x.doc_id, x["__n_lines"]) for x in got if x.text is None] == [(90, 0)]


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "p\nq\nr\ns")] * 3, "doc_id long, text string")
    assert sorted(x.text for x in r.dedup_lines(df).collect()) == ["", "", "p\nq\nr\ns"]
    assert r.dedup_lines(df.limit(0)).count() == 0


def test_overlapping_copies_leave_the_first_whole(spark):
    df = spark.createDataFrame([(1, "a\na\na\na\na"), (2, "x\ny\nx\ny\nx\ny\nx\ny"), (3, "a\na\na\nz")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in r.dedup_lines(df).collect()}
    assert got == {1: "a\na\na", 2: "x\ny\nx", 3: "z"}


def test_the_two_halves_of_an_id_are_independent(spark):
    """Spark's xxhash64(x, 1) follows from xxhash64(x); the halves here are hashes of two texts."""
    import xxhash

    df = spark.createDataFrame([(1, f"line {i}") for i in range(50)], "doc_id long, text string")
    base = df.selectExpr("doc_id as __rid", "doc_id as __id", "text as __text")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {(signed(xxhash.xxh64_intdigest(f"line {i}", 42)), signed(xxhash.xxh64_intdigest(f"bline {i}", 42))) for i in range(50)}
    assert {(x.a, x.b) for x in r._lines(base).collect()} == want
