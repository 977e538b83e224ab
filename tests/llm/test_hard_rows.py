"""Every operator and stage on nulls in any column, empty and very long texts, repeated rows, clashing names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrazzo.llm import bloom_lm, decontaminate, html_text, langid, line_runs, multiset_hash, pfair_mix, secrets, simhash, token_records

EXTRA = ["score", "lang_pred", "tkey", "fp", "w", "k", "rid", "items", "position", "component_id", "ids", "ord", "value", "__key", "__class", "__score", "__tkey", "__n", "__id", "__text", "__hits", "__part"]
ITEM = "one two three four five six seven eight nine ten eleven"
ROWS = [
    (1, "the cat and the dog of it " * 9, "en", "src0", 5),
    (1, "the cat and the dog of it " * 9, "en", "src0", 5),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (None, "der die und das ist nicht", "de", "src1", 1),
    (None, "der die und das ist nicht", "de", "src1", 1),
    (None, None, None, None, None),
    (4, "der die und das ist auch " * 20_000, "de", None, 7),
    (5, f"start {ITEM} end\nl1\nl2\nl3", "en", "x", 2),
    (6, "l1\nl2\nl3\n ß中\U0001f600\u0000 á �", None, "src2", 2),
    (7, " \t\n ", "en", "src2", 2),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("hard"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("n_chars").cast("string")) for c in EXTRA})
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, ITEM, "a"), (2, None, None), (None, "", "b"), (1, ITEM, "a")], "item_id long, text string, doc_id string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x", 2), (2, "u", "", 3), (2, "u", "<p>" + "y " * 90_000, 4)], "page_id long, url string, html string, text int").write.parquet(f"{sf}/pages.parquet")
    return sf


QUERIES = {n: q for m in (token_records, decontaminate, simhash, langid, multiset_hash, bloom_lm, pfair_mix, line_runs) for n, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_a_row_for_each_row(spark, tables, name):
    got = QUERIES[name](spark, tables).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in ROWS)


def test_pages_and_secrets(spark, tables):
    got = html_text.op9_html_text(spark, tables).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 179_999), ("None", 1)]
    assert secrets.candidates(spark.read.parquet(f"{tables}/documents.parquet")).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns(spark, tables, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, tables)
    assert out.columns == docs.columns
    rows = {str(r) for r in docs.collect()}
    assert all(str(r) in rows for r in out.collect())  # every value is as it was
    kept = sorted(str(r.doc_id) for r in out.collect())
    want = {1: ["1", "2", "4", "5", "6", "None"], 3: sorted(str(r[0]) for r in ROWS), 2: sorted(str(r[0]) for r in ROWS if r[0] != 5)}
    assert stage not in want or kept == want[stage]


def test_whole_pipeline(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    assert len(got) == len({r.start for r in got}) and 5 not in {r.doc_id for r in got}


def test_lines_with_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = line_runs.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_removed"] and out.count() == len(ROWS)


def test_no_rows(spark, tables, tmp_path):
    for t in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for query in [*QUERIES.values(), html_text.op9_html_text, secrets.op7_secret_scan, corpus_pipeline.run]:
        assert query(spark, str(tmp_path)).count() == 0
