import re

import pytest

from terrazzo.llm import secrets as s

AKIA = "AKIA" + "MD62HKU6VBLCCCCE"
HEX = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
DOCS = [
    (1, f"that heing {AKIA} anenensh"),
    (2, f'ingeran onatst token = "{HEX}" inonou'),
    (3, "and password=b7db7aa4a5fcc78305 enes\nand again b7db7aa4a5fcc78305"),
    (4, "call 4041894974608795 now, bosbt.42@mail8.example.com or 42.144.35.254"),
    (5, None),
    (6, ""),
    (None, f"see commit {HEX} for it, /usr/lib/python3.11/site.py"),
    (7, "word " * 30_000 + f"{AKIA} end"),
    (7, "word " * 30_000 + f"{AKIA} end"),
]


@pytest.fixture(scope="module")
def model(spark):
    return s.train(s.labelled_findings(spark))


def test_candidates_against_regex(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, value string")
    got = sorted(str((r.doc_id, r.value, r.start, r.n_found)) for r in s.candidates(df).collect())
    want = []
    for i, t in DOCS:
        found = re.findall(s.CANDIDATE, t or "")
        want += [str((i, v, t.index(v), found.count(v))) for v in dict.fromkeys(found)]
    assert got == sorted(want)


def test_decisions(spark, model):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = s.scan(df, model).collect()
    assert {(r.doc_id, r.value) for r in got if r.is_secret} == {(1, AKIA), (2, HEX), (3, "b7db7aa4a5fcc78305"), (7, AKIA)}
    assert sum(r.doc_id == 7 and r.is_secret for r in got) == 2


def test_held_out_findings(spark, model):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    fresh = s.labelled_findings(spark, 400).exceptAll(s.labelled_findings(spark))
    x = VectorAssembler(inputCols=s.FEATURES, outputCol="features").transform(s.with_features(fresh))
    assert model.transform(x).select(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("a")).first().a > 0.97


def test_empty_table(spark, model):
    assert s.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
