import random

import numpy as np

import corpus_pipeline
from terrazzo.llm import near_copies


def planted():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, common = [], " ".join(word() for _ in range(30))
    for k in range(60):
        base = [word() for _ in range(rnd.randrange(60, 200))]
        rows.append((10 * k, " ".join(base) + (" " + common if k % 2 else "")))
        for c in range(1, 5):  # c to 3 c words changed: similarity from about 0.95 down to 0.4
            copy = list(base)
            for _ in range(rnd.randrange(c, 3 * c + 1)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((10 * k + c, " ".join(copy) + (" " + common if k % 2 else "")))
    return rows + [(2000, None), (2001, ""), (2002, " \t"), (2003, "a b"), (2004, "A  b"), (2005, "a b c")]


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (not union or len(sets[a] & sets[b]) >= 0.8 * union):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in root}


def test_components_match_brute_force(spark):
    rows = planted()
    want = brute(rows)
    assert 80 < len(set(want.values())) < 250  # some copies are near enough and some are not
    got = {r.doc_id: r.component_id for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_stage_drops_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(brute(rows).values()))


def test_hot_group_and_null_ids(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[51:])) for i in range(400)] + [(None, "one two three four five six"), (None, "one two three four five six")]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["0", "None"]


def test_stage_joins_tries_of_fingerprints(spark, monkeypatch):
    tried, links = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda values: tried.append(values.columns) or links(values))
    monkeypatch.setattr(near_copies, "BLOCK", 3)  # buckets of more than three texts are dealt in pairs of blocks
    rows = planted()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute(rows).values())) and tried == [["fp"]]


def test_group_without_links_is_not_paired(spark, monkeypatch):
    """169 texts on a base of 200 words share buckets, but any two have a similarity of 0.73 or 0.77."""
    compared, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    rows = []
    for k in range(169):
        w = [f"w{i}" for i in range(200)]
        for slot in (k // 13, 13 + k % 13, 26 + (k // 13 + k % 13) % 13):
            w[slot * 5 + 2] = f"x{k}s{slot}"
        rows.append((k, " ".join(w)))
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 169
    assert sum(compared) < 169 * 25  # of 14,196 pairs


def test_budgets_hold_links():
    rnd = np.random.default_rng(3)
    first, most, most_small = near_copies.budgets(0.8)
    for shared, own in ((4, 1), (8, 1), (80, 10), (800, 100)):
        both = 200 if shared < 80 else 30
        for _ in range(both):
            h = rnd.integers(0, 1 << 64, shared + 2 * own, np.uint64)
            a, b = h[: shared + own], h[own:] if shared > 4 else h[:shared]
            bits = np.bitwise_count(near_copies.fingerprint(a) ^ near_copies.fingerprint(b))
            assert bits[0] <= first and bits.sum() <= (most_small if shared < 64 else most)


def test_forest_and_linking_match_all_pairs():
    rnd = np.random.default_rng(4)
    part = rnd.integers(0, 40, 60)
    i, j = np.triu_indices(60, 1)
    bits = rnd.integers(0, 9, len(i))
    keep = (part[i] != part[j]) & (rnd.random(len(i)) < 0.05)
    i, j, bits = i[keep], j[keep], bits[keep]

    def roots(places):
        label = part.copy()
        for p in places:
            label[label == label[j[p]]] = label[i[p]]
        return {tuple(np.flatnonzero(label == x)) for x in set(label)}

    forest = near_copies.least_forest(part, i, j, bits)
    assert roots(forest) == roots(range(len(i))) and len(forest) == len(set(part)) - len(roots(forest))
    ids = [np.unique(rnd.choice(24, 20, replace=False)).astype("<u4") for _ in range(60)]
    alike = [p for p in range(len(i)) if len(both := set(ids[i[p]]) & set(ids[j[p]])) >= 0.8 * (40 - len(both))]
    found = near_copies.linking(part, i, j, bits, ids, np.full(60, 20))
    assert alike and roots([p for p in found if p in alike]) == roots(alike)
