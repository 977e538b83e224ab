import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.llm import bloom_lm as lm

ROWS = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 23))) for i in range(120)] + [(500, None), (501, "Ünknown wörd"), (501, "Ünknown wörd"), (None, "W1 w2\tw1")]


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks)


@pytest.mark.parametrize("head,limit", [(lm.HEAD, lm.BROADCAST_BYTES), (3, 0)])
def test_base_against_brute_force(spark, monkeypatch, head, limit):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = lm.score(df, ~held).collect()
    assert sorted((str(r.doc_id), not r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(ROWS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    long = [r for r in got if r.n_tokens > 15 and not r.train]
    assert sum(r.score for r in long) > sum(r.base_score for r in long)  # these texts do follow word by word


def test_filter_levels():
    rng = np.random.default_rng(1)
    low = rng.choice(2**32, 20_000, replace=False).astype(np.uint32)
    c = rng.geometric(0.3, 20_000) ** 2
    filt = np.frombuffer(lm.build(low[:10_000], c[:10_000]), np.uint8)
    q = lm.levels(filt, low)
    assert (q[:10_000] >= lm.level(c[:10_000])).all()
    assert (q[:10_000] > lm.level(c[:10_000])).mean() < 0.04 and (q[10_000:] > 0).mean() < 0.04


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, F.lit(True)).count() == 0
