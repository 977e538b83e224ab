"""Aggregates that built-in functions don't have under the same rules, and reports made of several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upper_median(x: str) -> Column:
    """The value at place floor(n / 2) of the sorted values; for two values the greater."""
    s = F.array_sort(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def upper_percentile(x: str, share: float) -> Column:
    """The value at place floor(share * n) of the sorted values."""
    s = F.array_sort(F.collect_list(x))
    return F.get(s, F.least(F.floor(F.size(s) * share).cast("int"), F.size(s) - 1))


def exact_rank(df: DataFrame, by: list[str], x: str, share: float, name: str) -> DataFrame:
    """A07, A09 for groups too large for one row: the value at place floor(share * n), by counts of values.

    Equal values are one row after the first grouping, and a group's rows are running sums over them.
    """
    n = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*by).orderBy(x)
    run = n.withColumn("__s", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(W.partitionBy(*by)))
    at = F.least(F.floor(F.col("__n") * share), F.col("__n") - 1)
    return run.where((F.col("__s") > at) & (F.col("__s") - F.col("__c") <= at)).select(*by, F.col(x).alias(name))


def residuals(by: list[str], d: str, df: DataFrame) -> DataFrame:
    """Rms, mean, p90 and max of distances."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.col(d) * F.col(d))).alias("rms"), F.avg(d).alias("mean"), upper_percentile(d, 0.9).alias("p90"), F.max(d).alias("max"))


def mode_first(df: DataFrame, by: list[str], x: str, order: str) -> DataFrame:
    """The most frequent value of x in each group; among equals the one that comes first by `order`."""
    n = df.groupBy(*by, x).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*by).agg(F.max_by(F.col(x), F.struct("n", (-F.col("first")).alias("f"))).alias(x), F.max("n").alias("n"))


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def degree(edges: DataFrame, a: str, b: str) -> DataFrame:
    """A11."""
    return symmetric(edges, a, b).groupBy("node").agg(F.count("*").alias("degree"))


def passage_evidence(edges: DataFrame, halls: DataFrame, a: str, b: str, kind: str, kinds: list[str]) -> DataFrame:
    """A10: for each node the distinct neighbours, the distinct ones among `halls` (node), and edges of each kind."""
    both = symmetric(edges, a, b).join(halls.select(F.col("node").alias("other"), F.lit(True).alias("hall")), "other", "left")
    return both.groupBy("node").agg(F.count_distinct("other").alias("neighbors"), F.count_distinct(F.when(F.col("hall"), F.col("other"))).alias("hallways"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def envelope(x: str, y: str) -> list[Column]:
    """A12."""
    return [F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y")]


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and JSON bytes of each table."""
    parts = [t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).select(F.lit(k).alias("name"), "n", "bytes") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def agreement(matched: Column) -> list[Column]:
    """Matched, total and their ratio."""
    return [F.count_if(matched).alias("matched"), F.count("*").alias("total"), (F.count_if(matched) / F.count("*")).alias("share")]


def agrees(a: Column, b: Column, least: float = 2.0, share: float = 0.03) -> Column:
    """Within the greater of `least` and a share of b."""
    return F.abs(a - b) <= F.greatest(F.lit(least), b * share)


def content_version(rows: DataFrame, order: list[str], digits: int = 12, block: int = 2000) -> DataFrame:
    """A hash of all rows in order, as one row `version`: digests of blocks, then the digest of those.

    Rows are canonical JSON. Blocks are ranges of the first order column (a number), so no task sees all rows.
    """
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))))
    key = F.struct(*order)
    blocks = rows.groupBy(F.floor(F.col(order[0]) / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("j")))).alias("s"))
    digests = blocks.select("b", F.sha2(F.array_join(F.transform("s", lambda x: x["j"]), "\n"), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return digests.agg(F.left(F.sha2(whole, 256), F.lit(digits)).alias("version"))


def listing_hash(files: DataFrame, path: str, content: str) -> DataFrame:
    """Each file's 12-digit hash."""
    return files.select(path, F.left(F.sha2(content, 256), F.lit(12)).alias("revision"))


def best_component(nodes: DataFrame, component: str, flag: str) -> DataFrame:
    """The component with the most flagged nodes, then the most nodes, then the smallest name."""
    s = nodes.groupBy(component).agg(F.count_if(flag).alias("flagged"), F.count("*").alias("size"))
    return s.orderBy(F.col("flagged").desc(), F.col("size").desc(), component).limit(1)
