"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Fingerprint: a text's words ([^ \\t-\\r]+ after lower-casing A-Z) form shingles of three words, repeats
included (fewer words: one shingle of all of them; none: fingerprint zero). A bit is 1 if it is set in over
half of the shingles' XXH64 values (UTF-8, seed 42).

Join: distinct fingerprints are the leaves of a binary trie. The top `p` levels are laid out over tasks: the
subtree of prefix A is joined with itself and with every subtree B > A whose prefix differs in at most as many
bits as the budget, so each task walks node pairs of its subtrees together, adds up differing bits, and drops a
pair of nodes once the budget is exceeded. `p` grows with the number of fingerprints until the fullest subtree
is within SUBTREE_ROWS, so no task gets an unbounded part. A task returns a spanning forest of its links, which
keeps every connection and at most one row a fingerprint; components are then contracted over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.llm.common import pick, sheltered, text_key
from terrazzo.operators.components import connected_components
from terrazzo.session import staged

SHINGLE, BUDGET, SUBTREE_ROWS, SEED = 3, 2, 50_000, 42
LEAST_BITS, MOST_BITS = 6, 24


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned 64-bit integer; null counts as empty."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        return xxh64_intdigest(b" ".join(w), SEED)
    joined = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, tkey, fp): one for each row of `docs`, with the text's digest and its fingerprint as a signed long."""
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    d = d.select("doc_id", text_key(F.col("text")).alias("tkey"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm.simhash import fingerprint as of

        for b in batches:
            fp = np.array([of(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(fp)], ["doc_id", "tkey", "fp"])

    return d.mapInArrow(run, f"doc_id {kind}, tkey binary, fp long")


def walk(a: np.ndarray, b: np.ndarray | None, budget: int, most: int = 400_000, pairs: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted unsigned arrays whose values differ in at most `budget` bits; b None: i < j in a.

    Node pairs are index ranges; all pairs of a level are split at once, by the next bit. Pairs of small
    nodes are compared value by value. More than `most` node pairs are walked part by part.
    """
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    one = np.array
    stack = [(0, one([0]), one([len(a)]), one([0]), one([len(b)]), one([0], np.int64))]
    while stack:
        depth, a0, a1, b0, b1, d = stack.pop()
        small = ((a1 - a0) * (b1 - b0) <= pairs) | (depth == 64)
        if small.any():
            yield from _compare(a, b, a0[small], a1[small], b0[small], b1[small], budget, same)
            a0, a1, b0, b1, d = (x[~small] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        if len(a0) > most:
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, d))), (depth, *(x[half:] for x in (a0, a1, b0, b1, d)))]
            continue
        am, bm = _split(a, a0, a1, depth), _split(b, b0, b1, depth)
        own = same & (a0 == b0) & (a1 == b1)  # of a node with itself, only one of left-right and right-left
        parts = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), *([(am[~own], a1[~own], b0[~own], bm[~own], d[~own] + 1)])]
        c = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (c[4] <= budget) & (c[1] > c[0]) & (c[3] > c[2])
        stack.append((depth + 1, *(x[keep] for x in c)))


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    bit = np.uint64(1) << np.uint64(63 - depth)
    high = ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(v, (v[lo] & high) | bit), lo, hi)


def _compare(a, b, a0, a1, b0, b1, budget, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = (a1 - a0) * (b1 - b0)
    for at in range(0, len(n), 20_000):
        s = slice(at, at + 20_000)
        k = n[s]
        of = np.repeat(np.arange(len(k)), k)
        r = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
        width = (b1[s] - b0[s])[of]
        i, j = a0[s][of] + r // width, b0[s][of] + r % width
        hit = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            hit &= i < j
        if hit.any():
            yield i[hit], j[hit]


def spanning_forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node that the links connect it to."""
    label = np.arange(n)
    for i, j in links:
        while True:
            li, lj = label[i], label[j]
            differ = li != lj
            if not differ.any():
                break
            i, j, li, lj = i[differ], j[differ], li[differ], lj[differ]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while (label != (up := label[label])).any():
                label = up
    return label


def links(values: DataFrame, budget: int = BUDGET, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """Rows (src, dst): links of a spanning forest over the distinct longs in column fp, as the trie walk finds them."""
    n = values.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (max(n, 1) // subtree_rows).bit_length()))

    def prefix(bits: int) -> Column:
        return F.shiftrightunsigned("fp", 64 - bits).cast("long")

    while bits < MOST_BITS and n > subtree_rows:
        most = values.groupBy(prefix(bits).alias("p")).count().agg(F.max("count").alias("n")).first().n
        if most <= subtree_rows:
            break
        bits += 2
    masks = [0, *(1 << i for i in range(bits)), *(1 << i | 1 << j for i in range(bits) for j in range(i))]
    masks = [m for m in masks if m.bit_count() <= budget]
    at = F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask")
    placed = values.select("fp", prefix(bits).alias("p"), at)
    placed = placed.select("fp", F.col("p").bitwiseXOR(F.col("mask")).alias("home"), (F.col("mask") == 0).alias("own"), "p").where("home <= p")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        from terrazzo.llm.simhash import spanning_forest as forest
        from terrazzo.llm.simhash import walk as pairs

        v, own = group["fp"].to_numpy().view(np.uint64), group["own"].to_numpy()
        a, b = np.sort(v[own]), np.sort(v[~own])
        both = np.concatenate([a, b])

        def found():
            yield from pairs(a, None, budget)
            for i, j in pairs(a, b, budget):
                yield i, j + len(a)

        label = forest(len(both), found())
        moved = label != np.arange(len(both))
        return pd.DataFrame({"src": both[moved].view(np.int64), "dst": both[label[moved]].view(np.int64)})

    return placed.groupBy("home").applyInPandas(join, "src long, dst long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """Rows (doc_id, tkey, fp, component_id), one for each row of `docs`.

    component_id is the smallest document id that links of `budget` or fewer differing bits reach, the row's
    own included; null if all ids there are null. Null and empty texts have fingerprint zero and link like
    any other. Equal fingerprints are one leaf, so groups of copies cost one row after the first grouping.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    leaves = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-leaves")
    found = staged(links(leaves.select("fp"), budget), "simhash-links")
    of = connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    roots = leaves.join(of, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = staged(roots, "simhash-roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "tkey", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id (null ids last), then the smallest text digest.

    Rows that repeat id and text count as copies, so one of them stays. Columns are as they were.
    """
    docs, back = sheltered(docs)
    return back(keep_first(docs, components(docs, id_col, text_col, shingle, budget), id_col, text_col))


def keep_first(docs: DataFrame, c: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each component of `c`, which has the rows of components()."""
    c = staged(c, "simhash-components")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("tkey").alias("t"))
    # groups without any id are told apart by their fingerprints' root only through the digest kept here
    kept = c.groupBy("component_id").agg(F.min(order).alias("k")) if not _has_null_ids(c) else _kept_with_nulls(c, order)
    kept = kept.select(F.col("k.i").alias("doc_id"), F.col("k.t").alias("tkey")).distinct()
    times = c.groupBy("doc_id", "tkey").count()
    same = (times["tkey"] == kept["tkey"]) & times["doc_id"].eqNullSafe(kept["doc_id"])
    kept = staged(times.join(kept, same, "left_semi").select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"), (F.col("count") > 1).alias("__again")), "simhash-kept")
    key, row = text_key(F.col(f"`{text_col}`")), F.col(f"`{id_col}`")
    rows = docs.withColumn("__key", key)

    def of(kept: DataFrame) -> DataFrame:
        return rows.join(kept, (rows["__key"] == kept["__tkey"]) & row.eqNullSafe(kept["__id"]), "left_semi")

    names = [f"`{c}`" for c in docs.columns]
    once = of(kept.where("not __again")).select(*names)
    again = kept.where("__again")
    if again.isEmpty():
        return once
    first = W.partitionBy("__key", f"`{id_col}`").orderBy(F.lit(1))
    return once.unionByName(of(again).withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*names))


def _has_null_ids(c: DataFrame) -> bool:
    return not c.where("component_id is null").isEmpty()


def _kept_with_nulls(c: DataFrame, order: Column) -> DataFrame:
    with_id = c.where("component_id is not null").groupBy("component_id").agg(F.min(order).alias("k")).select("k")
    rest = c.where("component_id is null").groupBy("fp").agg(F.min(order).alias("k")).select("k")
    return with_id.unionByName(rest)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
