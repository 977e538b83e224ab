import random

import numpy as np
import pytest

from terrazzo.llm import simhash


def brute(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vs}


def test_trie_walk_finds_all_pairs():
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(300)]
    v = sorted({x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for x in base for _ in range(4)} | set(base))
    a = np.array(v, np.uint64)
    got = {(int(i), int(j)) for x, y in simhash.walk(a, None, 2, most=50) for i, j in zip(x, y)}
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (v[i] ^ v[j]).bit_count() <= 2}
    assert got == want
    b = a[::3].copy()
    got = {(int(i), int(j)) for x, y in simhash.walk(a, b, 2) for i, j in zip(x, y)}
    assert got == {(i, j) for i in range(len(v)) for j in range(len(b)) if (v[i] ^ int(b[j])).bit_count() <= 2}


def test_components_match_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rnd = random.Random(1)
    rows = [(1, base), (2, base.upper()), (3, None), (4, ""), (5, "x"), (6, "x y"), (7, base), (7, base), (None, base)]
    rows += [(100 + i, " ".join(rnd.choice("abcdefg") * 2 for _ in range(rnd.randrange(1, 9)))) for i in range(150)]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.components(df).collect()
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = brute(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((str(i), f, least[root[f]]) for (i, _), f in zip(rows, fps))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in got) == want
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_spark_hash_agrees(spark):
    text = "Straße über alles"
    got = spark.sql("select xxhash64('straße über alles') h").first().h & (2**64 - 1)
    assert simhash.fingerprint(text) == got


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(df).count() == 0 and simhash.deduplicate(df).count() == 0
