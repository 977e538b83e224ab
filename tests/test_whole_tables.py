"""Queries over whole tables: keys far beyond the small ones get the rows that the same points have under small keys."""

import shutil

import pytest

from terrazzo.plans import geo_queries as q

FAR = 5000  # a multiple of all moduli that points, homes and names take of a key


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = []
    for shift in (0, FAR):
        sf = tmp_path_factory.mktemp("sf")
        for t in ("nation", "supplier"):
            shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", sf)
        spark.range(1, 61).selectExpr(f"id + {shift} as c_custkey").write.parquet(f"{sf}/customer.parquet")
        out.append(str(sf))
    return out


@pytest.mark.parametrize("name", ["j08_nearest", "j09_nearest_one", "j11_snap", "j10_connect", "m25_blocked", "j07_match"])
def test_far_keys(spark, folders, name):
    near, far = (q.QUERIES[name](spark, sf) for sf in folders)
    key = "id" if name == "m25_blocked" else "c_custkey"
    rows = lambda df, shift: sorted(repr({**r.asDict(True), key: r[key] and r[key] - shift}) for r in df.collect())
    want = rows(near, 0)
    assert want and rows(far, FAR) == want
