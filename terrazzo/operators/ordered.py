"""Operators in which the order of rows carries meaning: ordinals, runs, chains, greedy choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinal(df: DataFrame, by: list[str], order: list[Column | str], name: str = "n") -> DataFrame:
    """A number from 1 within each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def first_of(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns of each group's first row, without a sort."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*columns), order).alias("f")).select(*by, "f.*")


def chain_edges(points: DataFrame, by: list[str], order: str, node: str, keep: Column) -> DataFrame:
    """Edges (a, b) between consecutive kept rows of a group; a dropped row breaks the chain."""
    w = W.partitionBy(*by).orderBy(order)
    p = points.withColumn("__ok", F.coalesce(keep, F.lit(False)))
    p = p.select(*by, order, F.col(node).alias("b"), "__ok", F.lag(node).over(w).alias("a"), F.lag("__ok").over(w).alias("__was"))
    return p.where(F.col("__ok") & F.col("__was")).select(*by, order, "a", "b")


def consecutive(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row beside the next of its group (next_ names)."""
    w = W.partitionBy(*by).orderBy(order)
    out = df.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns), F.lead(F.lit(True)).over(w).alias("__more"))
    return out.where("__more").drop("__more")


def islands(df: DataFrame, by: list[str], order: str, label: list[str]) -> DataFrame:
    """Runs of rows with the same labels: (by, run, labels, first, last, n)."""
    w = W.partitionBy(*by).orderBy(order)
    same = F.struct(*label).eqNullSafe(F.lag(F.struct(*label)).over(w))
    runs = df.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run", *label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def cyclic_runs(df: DataFrame, by: list[str], place: str, size: int, flag: Column) -> DataFrame:
    """Runs (start, n) of flagged places 0..size-1 on a ring; a run may pass the end. A full ring starts at 0."""
    on = df.where(flag).groupBy(*by).agg(F.collect_set(place).alias("s"))
    at = F.sequence(F.lit(0), F.lit(size - 1))
    has = lambda i: F.array_contains("s", i.cast("int"))
    starts = F.filter(at, lambda i: has(i) & ~has(F.pmod(i - 1, F.lit(size))))
    starts = F.when(F.size("s") == size, F.array(F.lit(0))).otherwise(starts)
    gap = lambda s: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: ~has(F.pmod(s + k, F.lit(size))))), F.lit(size))
    run = F.transform(starts, lambda s: F.struct(s.alias("start"), gap(s).alias("n")))
    return on.withColumn("s", F.col("s").cast("array<int>")).select(*by, F.explode(run).alias("r")).select(*by, "r.start", "r.n")


def next_marker(df: DataFrame, time: str, now: Column) -> DataFrame:
    """`state` past, next or later: next is every row at the first time not before now."""
    upcoming = df.where(F.col(time) >= now).agg(F.min(time).alias("__next"))
    state = F.when(F.col(time) < now, "past").when(F.col(time) == F.col("__next"), "next").otherwise("later")
    return df.join(F.broadcast(upcoming)).withColumn("state", state).drop("__next")


def longest_chain(df: DataFrame, by: list[str], x: str, least: float, most: float) -> DataFrame:
    """The most values of a group, in order, of which each lies least..most above the one before it.

    Starting from every value in turn the chain takes the next one in reach and skips nearer ones; a wider gap
    ends it. One fold over a group's sorted distinct values keeps the open chains.
    """
    g = df.groupBy(*by).agg(F.array_sort(F.collect_set(x)).alias("v"))

    def extend(chains: Column, y: Column) -> Column:
        grown = F.transform(chains, lambda c: F.when((y - c["last"] >= least) & (y - c["last"] <= most), F.struct(y.alias("last"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.array_append(grown, F.struct(y.alias("last"), F.lit(1).alias("n")))

    none = F.array().cast("array<struct<last:double,n:int>>")
    chains = F.aggregate(F.col("v").cast("array<double>"), none, extend)
    return g.select(*by, F.array_max(F.transform(chains, lambda c: c["n"])).alias("n"))


def greedy_choice(df: DataFrame, by: list[str], ident: str, score: str, x: str, y: str, least: int = 2, most: int = 4, ratio: float = 0.75, spacing: float = 8.0, face: str | None = None, face_reach: float = 30.0, face_degrees: float = 60.0) -> DataFrame:
    """Per group, best score first (ties: smaller id), take up to `most` rows.

    After `least` rows a score must reach `ratio` of the best. A row too near to a chosen one is passed over,
    as is one within `face_reach` of it that faces the same way within `face_degrees`. One fold per group.
    """
    item = F.struct((-F.col(score)).alias("s"), F.col(ident).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), (F.col(face) if face else F.lit(None)).cast("double").alias("f"))
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(g.dtypes)["items"]

    def step(chosen: Column, e: Column) -> Column:
        def near(c: Column) -> Column:
            d = F.hypot(c["x"] - e["x"], c["y"] - e["y"])
            turn = F.abs(F.pmod(c["f"] - e["f"] + 540, F.lit(360.0)) - 180)
            return (d < spacing) | F.coalesce((d < face_reach) & (turn < face_degrees), F.lit(False))

        full = F.size(chosen) >= most
        weak = (F.size(chosen) >= least) & (-e["s"] < ratio * -F.get(F.col("items"), F.lit(0))["s"])
        return F.when(full | weak | F.exists(chosen, near), chosen).otherwise(F.array_append(chosen, e))

    chosen = F.aggregate("items", F.array().cast(kind), lambda a, e: step(a, e).cast(kind))
    return g.select(*by, F.posexplode(chosen).alias("place", "c")).select(*by, (F.col("place") + 1).alias("place"), F.col("c.id").alias(ident))


def radius_dedupe(df: DataFrame, by: list[str], ident: str, x: str, y: str, radius: float) -> DataFrame:
    """Per group in id order, rows that aren't within `radius` of a kept one."""
    item = F.struct(F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(g.dtypes)["items"]

    def step(kept: Column, e: Column) -> Column:
        return F.when(F.exists(kept, lambda c: F.hypot(c["x"] - e["x"], c["y"] - e["y"]) < radius), kept).otherwise(F.array_append(kept, e)).cast(kind)

    return g.select(*by, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("c")).select(*by, F.col("c.id").alias(ident))


def apart(df: DataFrame, by: list[str], score: str, degrees: str, least: float = 10.0, most: int = 2) -> DataFrame:
    """The best `most` angles of a group (least score first) at least so many degrees apart on the circle."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(score).alias("s"), F.col(degrees).alias("d")))).alias("items"))
    kind = dict(g.dtypes)["items"]

    def step(kept: Column, e: Column) -> Column:
        near = F.exists(kept, lambda c: F.abs(F.pmod(c["d"] - e["d"] + 540, F.lit(360)) - 180) < least)
        return F.when((F.size(kept) >= most) | near, kept).otherwise(F.array_append(kept, e)).cast(kind)

    return g.select(*by, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("c")).select(*by, F.col("c.s").alias(score), F.col("c.d").alias(degrees))


def unordered_pairs(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """One edge for each unordered pair, the first; loops are dropped."""
    pair = [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    e = edges.where(F.col(a) != F.col(b)).select("*", *pair)
    return e.groupBy("lo", "hi").agg(F.min_by(F.struct(*edges.columns), order).alias("e")).select("e.*")


def segment_dedupe(segments: DataFrame, ends: list[str], order: str, digits: int = 1) -> DataFrame:
    """One segment for equal rounded ends in either direction, the first."""
    r = lambda c: F.floor(F.col(c) * 10**digits + 0.5) / 10**digits
    p, q = F.struct(r(ends[0]).alias("x"), r(ends[1]).alias("y")), F.struct(r(ends[2]).alias("x"), r(ends[3]).alias("y"))
    s = segments.select("*", F.least(p, q).alias("__p"), F.greatest(p, q).alias("__q"))
    return s.groupBy("__p", "__q").agg(F.min_by(F.struct(*segments.columns), order).alias("e")).select("e.*")


def trimmed(df: DataFrame, by: list[str], x: str, share: float = 0.8) -> DataFrame:
    """The floor(share * n) smallest of each group, by x and then all columns."""
    w = W.partitionBy(*by)
    n = F.count("*").over(w)
    return df.withColumn("__n", n).withColumn("__r", F.row_number().over(w.orderBy(*dict.fromkeys([x, *df.columns])))).where(F.col("__r") <= F.floor(F.col("__n") * share)).drop("__n", "__r")


def sorted_children(df: DataFrame, by: list[str], order: str, columns: list[str], name: str) -> DataFrame:
    """Each group's rows as a sorted array of structs."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
