"""JSON texts with a record a line are read by several tasks, others whole, with the same rows and places."""

import pytest
from pyspark.sql import functions as F

from terrazzo.sources import files

SCHEMA = "a long, b string"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def read(spark, path, text):
    path.write_text(text)
    return files.read_records(spark, str(path), SCHEMA)


def test_a_record_a_line_is_read_in_parts(spark, tmp_path, small_splits):
    df = read(spark, tmp_path / "a.json", "[\n" + ",\n".join(f'  {{"a":{i},"b":"x, {i}"}}' for i in range(100)) + "\n]\n")
    assert df.rdd.getNumPartitions() > 1
    assert sorted((r.ord, r.a, r.b) for r in df.collect()) == [(i, i, f"x, {i}") for i in range(100)]


@pytest.mark.parametrize("text", ['[\n {\n"a":1,\n"b":"q"\n },\n {"a":2}\n]', '[{"a":1,"b":"q"},{"a":2}]', '[\n{"a":1,"b":"q"},{"a":2}\n]', '[\n\n{"a":1,"b":"q"},\n{"a":2}]', '[\n{"a":1,"b":"q"},\n{"a":2}\n]'])
def test_other_shapes(spark, tmp_path, text):
    assert sorted((r.ord, r.a, r.b) for r in read(spark, tmp_path / "b.json", text).collect()) == [(0, 1, "q"), (1, 2, None)]


@pytest.mark.parametrize("text", ['[\n{"a":1} {"a":2}\n]', '[\n{"a":"x"}\n]', '[\n{"a":1}\n{"a":2}\n]'])
def test_broken_texts_stop(spark, tmp_path, text):
    with pytest.raises(Exception, match=r"c\.json"):
        read(spark, tmp_path / "c.json", text).collect()


def test_long_texts_are_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_LINES", 30)
    path = str(tmp_path / "features")
    k = F.col("id")
    f = files.feature(F.lit("Point"), F.array(k.cast("double"), F.lit(2.0)), F.create_map(F.lit("name"), F.concat(F.lit("n"), k)))
    files.write_lines(files.lines(spark.range(100), "id", f, '{"type":"FeatureCollection","features":[', "]}"), path)
    assert len(list((tmp_path / "features").glob("part-*"))) > 1
    got = files.read_features(spark, path).collect()
    assert sorted((r.ord, r.id, r.properties["name"]) for r in got) == [(i, f"override/{i}", f"n{i}") for i in range(100)]
    assert {r.lng for r in files.points_of(files.read_features(spark, path)).collect()} == set(map(float, range(100)))
