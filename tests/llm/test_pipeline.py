import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from terrazzo.llm import pfair_mix, simhash, token_records

EN = "the of and to in is that for it with as was on are be this have from or by".split()
DE = "der die und das ist nicht ein eine mit sich auf für von dem des auch wird bei über zwischen".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(5)
    make = lambda ws, n: " ".join(rnd.choice(ws) + rnd.choice(["", "ing", "ung", "er"]) for _ in range(n))
    item = make(EN, 14)
    rows = [(i, make(EN, 40 + i % 9), "en", f"src{i % 12}") for i in range(60)] + [(i, make(DE, 50), "de", "src0") for i in range(60, 90)]
    rows += [(100, "12345 67 89 ...", "en", "src1"), (101, None, "en", "src1"), (102, "", None, None)]
    rows += [(103, rows[3][1], "en", "src2"), (104, rows[70][1].upper(), "de", None)]
    rows += [(105, make(EN, 20) + " " + item.upper().replace(" ", ", ") + " " + make(EN, 20), "en", "src3")]
    sf = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return rows, item, str(sf)


def test_against_brute_force(spark, corpus):
    rows, item, sf = corpus
    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    seen, roots = [], []
    for r in sorted(kept):
        f = simhash.fingerprint(r[1])
        if not any((f ^ g).bit_count() <= 2 for g in seen):
            roots.append(r)
        seen.append(f)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    w = words(item)
    grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = [r for r in roots if not any(tuple(x) in grams for x in zip(*(words(r[1])[i:] for i in range(10))))]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in clean]
    assert 105 not in {r[0] for r in clean} and 103 not in {r[0] for r in clean} and len(clean) == 91  # 104 keeps its umlauts in upper case
    t = Tokenizer.from_file(token_records.default_encoding().tokenizer)
    ids = {r[0]: t.encode(r[1], add_special_tokens=False).ids + [2] for r in clean}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], len(r[1])) for r in clean], "doc_id long, text string, lang string, source string, n_chars long")
    want = [r.doc_id for r in pfair_mix.mix(docs, pfair_mix.WEIGHTS).orderBy("__position").collect()]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == want


def test_stages_keep_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[2]}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus[2]).columns == docs.columns
        assert stage(spark, empty, corpus[2]).count() == 0
    assert corpus_pipeline.records(spark, empty, corpus[2]).count() == 0
