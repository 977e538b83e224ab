import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrazzo.llm import token_records as t
from terrazzo.session import fresh_path

TEXTS = ["", None, "Hello, World! it's we'll", "naïve Ünï ǅ ﬁ ẞ İstanbul ΑΣ", "é a\x1cb\x85c\xa0d\te", "<|endoftext|>x <|startoftext|>", "漢字 12345 !!! 🙂🙂", "a " * 3000, "a\r\nb\n\n  c"]


def brute(rows, name="word_bpe_49k.json", end=2):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    out, at = [], 0
    ids = [(i, tok.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in rows]
    key = lambda r: (-(2**63) if r[0] is None else r[0], zlib.crc32(np.array(r[1], "<u2").tobytes()), r[0] is not None, r[0] or 0)
    for i, x in sorted(ids, key=key):
        out.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


@pytest.mark.parametrize("shard,width", [(10**9, 2), (700, 4)])
def test_round_trip(spark, shard, width):
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)]) for i in range(50)] + [(None, "null id")]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, start int")
    e = t.Encoding(t.default_encoding().tokenizer, width=width)
    manifest = t.write_records(df, e, fresh_path(spark, "records"), shard_chars=shard)
    assert (manifest.count() > 1) == (shard < 10**9)
    got = t.read_records(manifest, width).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == brute(rows)


def read_all(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    e = t.default_encoding()
    manifest = t.write_records(df, e, fresh_path(spark, "records"), **kwargs)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in t.read_records(manifest, e.width).orderBy("start").collect()]
    return manifest, got


def test_null_and_hot_ids_are_spread(spark):
    rows = [(None, f"null {i}") for i in range(60)] + [(7, f"hot {i}") for i in range(60)] + [(i, "x") for i in range(30)]
    manifest, got = read_all(spark, rows, shard_chars=200_000)
    assert got == brute(rows)
    manifest, got = read_all(spark, rows, shard_chars=40)
    assert got == brute(rows)
    assert manifest.count() > 12 and manifest.agg({"n_records": "max"}).first()[0] < 40


def test_shuffled_reading(spark):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(200)]
    manifest, got = read_all(spark, rows, shard_chars=500)
    shuffled = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in t.read_records(manifest, 2, seed=3).collect()]
    again = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in t.read_records(manifest, 2, seed=3).collect()]
    assert shuffled == again != got and sorted(shuffled, key=lambda r: r[1]) == got


def test_more_shards_than_at_once(spark):
    df = spark.createDataFrame([(i * i % 997, "abc" * (i % 5)) for i in range(500)], "doc_id long, text string")
    cuts = t.shard_cuts(df, 30, "text", "doc_id", rows=5, at_once=8)
    assert len(cuts) > 30 and list(cuts) == sorted(cuts)


def test_any_tokenizer(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    e = t.Encoding(public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)
    got = t.read_records(t.write_records(df, e, fresh_path(spark, "records"))).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == brute(rows, "byte_bpe_50k.json", 50256)
    with pytest.raises(ValueError):
        t.PieceEncoder(t.Encoding(public_tokenizers.path("byte_bpe_50k.json"), end_id=70_000))


def test_forgetting_pieces():
    import dataclasses

    import pyarrow as pa

    small, large = (t.PieceEncoder(dataclasses.replace(t.default_encoding(), cache=n)) for n in (3, 10**6))
    texts = pa.array([f"word{i % 5} Été{i} x{i}, <|endoftext|>" for i in range(40)] + TEXTS)
    for _ in range(2):
        for lo in range(0, len(texts), 7):
            assert small.batch(texts.slice(lo, 7)) == large.batch(texts.slice(lo, 7))


def test_damage_is_found():
    good = t.frame(b"payload")
    assert bytes(t.unframe(memoryview(good), 0)[0]) == b"payload"
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            t.unframe(memoryview(bytes(bad)), 0)
    for n in range(len(good)):
        with pytest.raises(ValueError):
            t.unframe(memoryview(good[:n]), 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert t.read_records(t.write_records(df, t.default_encoding(), fresh_path(spark, "records"))).count() == 0
