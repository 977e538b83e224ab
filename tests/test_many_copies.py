"""Tables in which places, shapes and keys' remainders repeat: rows stay those of the SQL, and joins grow with the rows."""

import importlib
import shutil
from pathlib import Path

import pytest
from oracle import compare, connect, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrazzo import session

SHIFT = 126_000  # a multiple of all moduli that places, floors and numbers take of a key
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def most_joined(df):
    """The most rows that a join of the collected `df` made."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        made = plan.metrics().get("numOutputRows") if "Join" in name else None
        below = plan.children()
        return max([made.get().value() if made is not None and made.isDefined() else 0, *(walk(below.apply(i)) for i in range(below.size()))])

    rows = df.collect()
    return rows, walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables, and four and eight copies of them."""
    out = []
    for n in (1, 4, 8):
        sf = tmp_path_factory.mktemp(f"copies{n}")
        for path in Path("/root/testdata/sf0.001").iterdir():
            if path.stem not in KEYS:
                (sf / path.name).symlink_to(path)
        for t, k in KEYS.items():
            src = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
            src.crossJoin(spark.range(n).withColumnRenamed("id", "__i")).withColumn(k, F.col(k) + SHIFT * F.col("__i")).drop("__i").coalesce(1).write.parquet(f"{sf}/tmp-{t}")
            (part,) = (sf / f"tmp-{t}").glob("part-*.parquet")
            shutil.move(part, sf / f"{t}.parquet")
        out.append(str(sf))
    return out


@pytest.mark.parametrize(("name", "key", "below"), [("j08_nearest", "c_custkey", 1000), ("j09_nearest_one", "c_custkey", 1000), ("j11_snap", "c_custkey", 1000), ("m25_blocked", "id", 300)])
def test_small_keys_as_in_sql(spark, folders, name, key, below):
    df = QUERIES[name](spark, folders[1]).where(f"{key} < {below}")
    rel = connect(folders[1]).execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    assert want and rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", ["p03_nodes", "m08_distance", "g19_nearest_node", "x05_x06_segments", "j20_rooms", "j16_nearest"])
def test_copies_as_in_sql(spark, folders, name):
    assert compare(spark, connect(folders[1]), folders[1], QUERIES[name], ORACLE[name]) == []


@pytest.mark.parametrize("name", ["j08_nearest", "j09_nearest_one", "j10_connect", "j11_snap", "m25_blocked", "p03_nodes", "m08_distance", "x05_x06_segments", "j20_rooms"])
def test_joins_grow_with_rows(spark, folders, name):
    four, eight = (most_joined(QUERIES[name](spark, sf))[1] for sf in folders[1:])
    assert 0 < eight <= 2.1 * four


@pytest.mark.parametrize(("module", "name"), [("graph", "g19_nearest_node"), ("lookup", "j16_nearest")])
def test_staged_joins_grow_with_rows(spark, folders, monkeypatch, module, name):
    """As above for joins behind tables that are written on the way."""
    made = []
    keep = session.staged

    def staged(df, what):
        made.append(most_joined(df)[1])
        return keep(df, what)

    for m in ("spatial", module):
        monkeypatch.setattr(importlib.import_module(f"terrazzo.operators.{m}"), "staged", staged, raising=False)
    most = []
    for sf in folders[1:]:
        made.clear()
        most.append(max(most_joined(QUERIES[name](spark, sf))[1], *made))
    assert 0 < most[1] <= 2.1 * most[0]


def test_numbers_of_more_than_six_digits(spark, folders, tmp_path):
    """Keys of seven digits are searched and cut off labels whole."""
    for path in Path(folders[0]).iterdir():
        if path.stem != "part" and path.suffix == ".parquet":
            (tmp_path / path.name).symlink_to(path.resolve())
    src = spark.read.parquet(f"{folders[0]}/part.parquet")
    src.withColumn("p_partkey", F.col("p_partkey") + 1_000_000).coalesce(1).write.parquet(str(tmp_path / "tmp-part"))
    (part,) = (tmp_path / "tmp-part").glob("part-*.parquet")
    shutil.move(part, tmp_path / "part.parquet")
    for name in ("t01_search", "f01_f06_forms"):
        assert compare(spark, connect(str(tmp_path)), str(tmp_path), QUERIES[name], ORACLE[name]) == []
