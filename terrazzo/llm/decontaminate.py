"""Benchmark decontamination: a set of normalised test n-grams against every token window of the training texts.

Words are digits, a-z (after lower-casing A-Z) and everything outside ASCII. A window is ten consecutive words
of an item; an item of one to nine words is one window as a whole. The work has two passes.

1. Probe. If a text holds a window of length L, then among its k-grams at every s-th word, with
   s = (L + 1) // 2 and k = L - s + 1, at least one lies inside that occurrence. So a text needs only one probe
   every s words against the k-grams of all windows, and most texts end here.
2. Verify. Texts with a probe hit are scanned at every word and compared with the windows themselves, as strings.

Both sets come from the benchmark and are broadcast only after they were counted; beyond the bound the same
joins run as shuffles. Texts are known by a digest, so copies are verified once, and neither null nor repeated
document ids matter. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm.common import WORD_GAP, lower_ascii, pick, sheltered, text_key, words
from terrazzo.session import broadcast_if, staged

WINDOW = 10
#: A broadcast set has at most this many rows (windows are strings of some hundred bytes).
MAX_BROADCAST_ROWS = 1_000_000


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Rows (win, len, items): each distinct window with the sorted distinct ids of its items as strings.

    Items without words give none. A null item id adds no id, but its windows still count as hits.
    """
    w = pick(bench, item=id_col, text=text_col).select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(size)))
    each = w.select("item", "len", F.explode(_grams(F.col("w"), F.col("len"), 1)).alias("win"))
    return each.groupBy("win", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _grams(w: Column, k: Column | int, step: int) -> Column:
    """The k-grams of the array w from every step-th word, space-joined."""
    last = F.size(w) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.slice(w, i + 1, k if isinstance(k, Column) else F.lit(k))))


def _hashed(w: Column, k: int, step: int) -> Column:
    """As _grams, as hashes."""
    last = F.size(w) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), F.slice(w, i + 1, k)))


def scan(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Rows (tkey, hits, items) for each distinct text with a window: hits are the sorted (at, len) word ranges.

    `tkey` is the digest of the text (common.text_key). Texts without a window have no row. An empty
    benchmark or table gives an empty result.
    """
    wins = staged(windows(bench, item_col, item_text_col, size), "decon-windows")
    lengths = sorted(r.len for r in wins.select("len").distinct().collect())  # at most `size` rows
    n_wins = wins.count()
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    if not lengths:
        return docs.sparkSession.createDataFrame([], "tkey binary, hits array<struct<at:int,len:int>>, items array<string>")

    plan = {n: (n - (n + 1) // 2 + 1, (n + 1) // 2) for n in lengths}  # length -> k, step
    keys = None
    for n, (k, _) in plan.items():
        own = wins.where(F.col("len") == n).select(F.explode(_hashed(F.split("win", " "), k, 1)).alias("probe"))
        keys = own if keys is None else keys.unionByName(own)
    keys = keys.distinct()
    probes = F.flatten(F.array(*(_hashed(F.col("w"), k, step) for k, step in sorted(set(plan.values())))))
    probed = texts.select(text_key(F.col("text")).alias("tkey"), words(F.col("text")).alias("w"))
    probed = probed.select("tkey", F.explode(probes).alias("probe"))
    bound = n_wins * size  # no window has more k-grams
    found = probed.join(broadcast_if(keys, bound, MAX_BROADCAST_ROWS), "probe", "left_semi").select("tkey").distinct()
    found = staged(found, "decon-found")

    held = texts.select(text_key(F.col("text")).alias("tkey"), "text")
    held = held.join(broadcast_if(found, found.count(), MAX_BROADCAST_ROWS), "tkey", "left_semi").dropDuplicates(["tkey"])
    held = held.select("tkey", words(F.col("text")).alias("w"))
    at = F.array(*(_placed(n) for n in lengths))
    each = held.select("tkey", F.explode(F.flatten(at)).alias("x")).select("tkey", "x.at", "x.len", "x.win")
    hit = each.join(broadcast_if(wins, n_wins, MAX_BROADCAST_ROWS), ["win", "len"])
    by_window = hit.groupBy("tkey", "win", "len").agg(F.collect_list("at").alias("ats"), F.first("items").alias("items"))
    spans = F.transform("ats", lambda a: F.struct(a.alias("at"), F.col("len").alias("len")))
    return (
        by_window.select("tkey", spans.alias("spans"), "items")
        .groupBy("tkey")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )


def _placed(n: int) -> Column:
    return F.transform(_grams(F.col("w"), n, 1), lambda g, i: F.struct(i.alias("at"), F.lit(n).alias("len"), g.alias("win")))


def covered(hits: Column) -> Column:
    """How many words the sorted (at, len) ranges cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["at"]))).alias("n"))

    return F.aggregate(hits, start, add, lambda a: a["n"])


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: (doc_id, n_words, n_hit, n_items, items, contaminated).

    Null or empty texts have no words. Repeated rows each keep their row; null ids stay null.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.select("doc_id", text_key(F.col("text")).alias("tkey"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    # written first, so that the join's sides come straight from a shuffle and copies of a hot text can be split
    out = d.join(staged(scan(docs, bench, text_col), "decon-hits"), "tkey", "left")
    n_hit = F.coalesce(covered(F.col("hits")), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents", text_col: str = "text") -> DataFrame:
    """`docs` without its contaminated documents, or ("spans") with the hit words cut from their texts.

    All columns keep their names and order. In mode "spans" the gap after a cut word goes with it, and all
    other characters stay; documents without a hit keep their text byte for byte in either mode.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    docs, back = sheltered(docs)
    hits = staged(scan(docs, bench, text_col).select(F.col("tkey").alias("__tkey"), F.col("hits").alias("__hits")), "decon-hits")
    text = F.col(f"`{text_col}`")
    if mode == "documents":  # the digests alone: at most the bound's rows of 16 bytes are broadcast, else texts are shuffled
        keys = broadcast_if(hits.select("__tkey"), hits.count(), MAX_BROADCAST_ROWS)
        return back(docs.join(keys, text_key(text) == F.col("__tkey"), "left_anti"))
    # words and gaps take turns; a leading gap shifts the words by one
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    lead = F.when(lower_ascii(text).rlike("^" + WORD_GAP), 1).otherwise(0)

    def stays(_: Column, i: Column) -> Column:
        at = F.floor((i - lead) / 2)
        return (i < lead) | ~F.exists("__hits", lambda h: (h["at"] <= at) & (at < h["at"] + h["len"]))

    cut = F.array_join(F.filter(pieces, stays), "")
    joined = docs.join(hits, text_key(text) == F.col("__tkey"), "left")
    return back(joined.select(*(F.when(F.col("__hits").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns)))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    r = report(docs, bench)
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op1_decontaminate": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
         FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bw)),
lens AS (SELECT DISTINCT n FROM wins),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM p),
hits AS (SELECT g.doc_id, g.s, g.n, wins.item FROM g JOIN wins ON g.win = wins.win AND g.n = wins.n),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
QUERIES = {"op1_decontaminate": op1_decontaminate}
