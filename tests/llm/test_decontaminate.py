import hashlib
import re

from pyspark.sql import functions as F

from terrazzo.llm import decontaminate as d

LONG = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (2, "Short item here"), (2, "Short item here"), (3, ""), (None, "no id for this item"), (4, None), (11, "four five six seven eight nine ten eleven twelve thirteen"), (5, "solo")]
DOCS = [
    (1, "start " + LONG.replace(" ", ", ").upper() + " end"),
    (2, "a short, item! HERE and short item here"),
    (3, None),
    (4, ""),
    (5, "two three four five six seven eight nine ten eleven"),
    (5, "two three four five six seven eight nine ten eleven"),
    (None, "x no id for this item y solo"),
    (6, "nothing of the kind " * 400),
    (7, "ünï " + LONG + " thirteen"),
    (8, "...one two three four five six seven eight nine TEN? rest stays. "),
]


def brute(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(len(x), 10)
        for s in range(len(x) - n + 1) if n else []:
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[s : s + n]:
                    hit |= set(range(at, at + n))
                    ids |= {str(i)} if i is not None else set()
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, tkey string, win string"),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"),
    )


def test_against_brute_force(spark):
    docs, items = frames(spark)
    got = d.report(docs, items).withColumn("sha", F.sha2(F.concat_ws(",", "items"), 256)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated)) for r in got) == sorted(str((i, *brute(t, ITEMS))) for i, t in DOCS)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(d, "MAX_BROADCAST_ROWS", 0)
    test_against_brute_force(spark)


def test_removal(spark):
    docs, items = frames(spark)
    clean = d.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t in DOCS if not brute(t, ITEMS)[4])
    cut = {str(r.doc_id): r.text for r in d.decontaminate(docs, items, "spans").collect()}
    assert len(cut) == 9 and cut["6"] == DOCS[7][1] and cut["3"] is None
    assert cut["1"] == "start end" and cut["8"] == "...rest stays. " and cut["7"] == "ünï " and cut["2"] == "a and "


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert d.report(docs.limit(0), items).count() == 0
    assert {r.contaminated for r in d.report(docs, items.limit(0)).collect()} == {False}
