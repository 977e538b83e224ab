import math
import random

from pyspark.sql import functions as F

from terrazzo.streaming import fixes as S

BOX = (0.0, 0.0, 100.0, 100.0)


def make(n=120, users=4):
    rnd, out = random.Random(3), []
    for i in range(n):
        code = rnd.choice([None] * 8 + [1, 2])
        x = rnd.choice([None, math.nan] + [rnd.uniform(-600, 700) for _ in range(3)] + [rnd.uniform(0, 3) for _ in range(5)])
        out.append((i % users, i, x, rnd.uniform(0, 3), rnd.choice([None, 10.0, 200.0]), rnd.choice([None, 0.1, 2.0]), code))
    return out


def plain(rows):
    return sorted((r.user_id, r.ord, None if r.heading is None or math.isnan(r.heading) else round(r.heading, 6), r.state, r.moved) for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = make()
    for i in range(3):  # three micro-batches, each later in every user's order
        spark.createDataFrame(rows[i * 40 : i * 40 + 40], S.FIX).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(S.FIX).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = S.stream(source, BOX).writeStream.format("memory").queryName("fixes_out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = plain(S.fold(spark.createDataFrame(rows, S.FIX), BOX).collect())
    assert len(want) == 120 and plain(spark.table("fixes_out").collect()) == want


def test_small_moves_keep_the_last_point(spark):
    rows = [(1, 1, 0.0, 0.0, None, None, None), (1, 2, 0.0, 3.0, None, None, None), (1, 3, 0.0, 5.0, None, None, None), (1, 4, 5.0, 5.0, 90.0, 0.1, None)]
    got = S.fold(spark.createDataFrame(rows, S.FIX), BOX).orderBy("ord").collect()
    assert [(r.heading, r.moved) for r in got] == [(None, True), (None, False), (0.0, True), (90.0, True)]


def test_errors(spark):
    rows = [(1, 1, None, None, None, None, 2), (1, 2, 1.0, 1.0, 5.0, None, None), (1, 3, None, None, None, None, 2), (1, 4, None, None, None, None, 1), (1, 5, None, None, None, None, 3)]
    got = S.fold(spark.createDataFrame(rows, S.FIX), BOX).orderBy("ord").collect()
    assert [r.state for r in got] == ["unavailable", "on", "on", "denied", "unavailable"]
    assert [r.heading for r in got] == [None, 5.0, 5.0, None, None]


def test_empty(spark):
    assert S.fold(spark.createDataFrame([], S.FIX), BOX).count() == 0


def test_runs_are_coalesced(spark):
    e = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 2.0, 10.0, 11.0, 50.0)], "who string, t double")
    got = S.coalesced_runs(e, 10.0, "who", "t").orderBy("at").collect()
    assert [(r.at, r.n) for r in got] == [(0.0, 1), (10.0, 3), (20.0, 1), (50.0, 1)]


def test_snapping(spark):
    df = spark.createDataFrame([(7.0, 0.0, "on"), (20.0, 3.0, "on"), (20.0, None, "on"), (26.0, 90.0, "on"), (1.0, 9.0, "indoors"), (None, 9.0, "on")], "d double, a double, s string")
    assert [r[0] for r in df.select(S.snaps(F.col("d"), F.col("a"), F.col("s"))).collect()] == [True, False, True, False, False, False]
