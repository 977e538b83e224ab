import random

import numpy as np

from terrazzo.llm import langid as l

WORDS = {"en": "the of and to in that it with as was on this from", "de": "der die und das nicht ein mit sich für über", "fr": "le la les des une est dans que pour être", "es": "el los una que del por con para año está"}


def rows(n=300):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        out.append((i, " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randrange(6, 40))), lang))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "de"), (None, "the of and that was from this", None), (5, data[5][1], "de"), (1003, "the " * 50_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in data + odd], "doc_id long, text string, lang string, score string")
    got = l.identify(df).collect()
    assert len(got) == len(data) + len(odd)
    truth = {i: g for i, _, g in data}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if l.crc_remainder(i, 4) == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "en" and by[1003].lang_pred == "en" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    kept = l.accept(df)
    assert kept.columns == df.columns and kept.count() == len(got) - 3


def test_codewords_are_apart():
    for n in (2, 4, 6, 9):
        m = l.codewords(n)
        assert min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 4)


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert l.identify(df).count() == 0
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in l.identify(one).collect()] == [("und", 0.0)]
