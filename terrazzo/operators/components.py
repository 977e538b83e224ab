"""Connected components of an undirected edge list by repeated minimum-neighbour contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.session import staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node with an edge; the component is its smallest node.

    Each round every vertex takes its smallest neighbour as parent, two pointer jumps shorten the parent
    chains, and the edges are contracted onto the parents, so the edge list shrinks until none is left.
    Edges with a null end are ignored; self-loops give their node a component of its own.
    Each round's tables are written to the shared folder, which ends lineage.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = staged(_canonical(e), "cc-edges")
    links: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
            parent = parent.join(up, "p", "left").select("a", F.coalesce("g", "p").alias("p"))
        parent = staged(parent, "cc-parent")
        links.append(parent)
        by_b = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = e.join(parent, "a").join(by_b, "b").select(F.col("p").alias("a"), F.col("pb").alias("b"))
        e = staged(_canonical(moved), "cc-edges")
    label = nodes.select("node", F.col("node").alias("component"))
    for parent in links:
        step = parent.select(F.col("a").alias("component"), "p")
        label = label.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return label


def _canonical(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
