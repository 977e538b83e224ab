"""Session helpers: table loading, the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, read by Spark alone so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as Spark itself resolves it, with the scheme of its file system, so other readers find the same place."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", full))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; without that setting a temporary one in local mode, else ValueError.

    The checkpoint folder of the context is set along the way, so `DataFrame.checkpoint` works after this.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="terrazzo-"))
        base = _LOCAL[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    path = f"{shared_dir(spark)}/terrazzo/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete what fresh_path has handed out in this process, once no DataFrame that reads it is needed; their number."""
    jvm, n = spark.sparkContext._jvm, len(_MADE)
    for path in _MADE:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.clear()
    return n


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """A broadcast hint when the counted `rows` are within `max_rows`; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows <= max_rows else df
