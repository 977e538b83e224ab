"""A training corpus in five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage's result is written as Parquet and read again as the next one's docs. All but the last keep the
columns of documents; the order that mixing decides lives in the order of part files and of rows in them, where
the last stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import decontaminate, langid, near_copies, pfair_mix, token_records
from terrazzo.llm.common import sheltered
from terrazzo.session import fresh_path

#: Rows below this score have no clear language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language; texts without letters go."""
    return langid.accept(docs, least_score=LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more in five-word shingles connect, that of the smallest id."""
    return near_copies.deduplicate(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mix of their sources."""
    docs, back = sheltered(docs)
    return back(pfair_mix.in_order(pfair_mix.mix(docs, pfair_mix.WEIGHTS), docs.columns))


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as binary records in the order of the mix, read back: (doc_id, start, n_tokens, ids_crc32).

    The order is that of part files and of rows in them; docs that come from no files are in the order of doc_id.
    Null texts have their end id alone; rows that repeat are all written; an empty table gives no rows.
    """
    docs, order = docs.select("doc_id", "text", *(["_metadata"] if docs.inputFiles() else [])), "doc_id"
    if "_metadata" in docs.columns:
        number = F.regexp_extract_all("_metadata.file_name", F.lit(r"part-(\d+)|-c(\d+)"), F.lit(0))
        digits = F.transform(number, lambda x: F.regexp_extract(x, r"\d+", 0).cast("long"))
        place = F.coalesce(F.try_element_at(digits, F.lit(1)), F.lit(0)) * F.lit(1 << 40) + F.coalesce(F.try_element_at(digits, F.lit(2)), F.lit(0)) * F.lit(1 << 32)
        docs, order = docs.withColumn("__order", place + F.col("_metadata.row_index")).drop("_metadata"), "__order"
    encoding = token_records.default_encoding()
    manifest = token_records.write_records(docs, encoding, fresh_path(spark, "corpus-records"), order_col=order)
    return token_records.read_records(manifest, encoding.width).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("mixture", mixture),
    ("records", records),
]
#: Language and fingerprints are beyond SQL; tests/llm/test_pipeline.py holds a small corpus against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
