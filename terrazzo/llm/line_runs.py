"""Line dedup: repeated runs of lines by distributed prefix doubling; later copies are deleted.

Every line gets a 128-bit id by two hashes, and the corpus is the sequence of its documents' line ids. Only lines whose
id occurs twice can lie in a repeated run, so all others are dropped first; a run never crosses one of them nor the
end of its document. Doubling then names runs: the name of 2w lines at p is made of the names of w lines at p and
at p + w, and positions whose name occurs once drop out before the next round. Any length between w and 2w is
named by two overlapping names. Suffixes with one name at length n are exactly an interval of the suffix array in
which every common prefix is n or longer, so the intervals come from grouping by name; the order of different
suffixes, which nothing here depends on, is never sorted out.

Doubling stops at `min_lines`: of a longer repeated run each window of so many lines repeats, too, and the lines of
those windows are the run's. So windows stand in for the sorted suffix array and its intervals of longer prefixes.

A run counts if it has `min_lines` lines, or fewer with `min_words` words. Of the occurrences of a run the first
(by document id, nulls last, then place) stays; all lines of the others are deleted, but for those that the first
one has itself where they overlap: of a, a, a, a, a the first three lines stay. Occurrences of different runs join,
so what is deleted is the union of the maximal repeated runs that have an earlier copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm.common import sheltered
from terrazzo.session import staged

MIN_LINES, MIN_WORDS = 3, 50


def _lines(base: DataFrame) -> DataFrame:
    """Rows (rid, pos, a, b, words, k): a line's id is (a, b); k orders documents and copies of a document."""
    line = F.posexplode(F.split(F.col("__text"), "\n", -1)).alias("pos", "line")
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    rows = base.where("__text is not null").select("__rid", "__id", line)
    return rows.select(F.col("__rid").alias("rid"), F.col("__id").alias("id"), "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.concat(F.lit("b"), "line")).alias("b"), n.alias("words"))


def _repeated(named: DataFrame, width: int) -> DataFrame:
    """The rows whose name (a, b) of `width` lines occurs more than once; `later`: not its first place; `skip`: how many
    of its lines the first place of that name has, too.

    The first places are written before the join: so both its sides come straight from a shuffle, and adaptive
    execution can split the rows of a line that a large share of all documents have.
    """
    place = F.struct(F.col("id").isNull().alias("n"), "id", "rid", "pos")
    first = named.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = staged(first, "runs-first")
    same = F.col("first.rid") == F.col("rid")
    both = named.join(first, ["a", "b"]).withColumn("later", ~same | (F.col("first.pos") != F.col("pos")))
    return both.withColumn("skip", F.when(same, F.greatest(F.lit(0), F.col("first.pos") + width - F.col("pos"))).otherwise(0)).drop("first")


def _joined(left: DataFrame, right: DataFrame, shift: int) -> DataFrame:
    """Runs of left's names at pos followed by right's at pos + shift; words is that of lines 0..shift-1 and right's."""
    r = right.select("rid", (F.col("pos") - shift).alias("pos"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    both = left.join(r, ["rid", "pos"])
    return both.select("rid", "id", "pos", F.xxhash64(F.lit(shift), "a", "ra").alias("a"), F.xxhash64(F.lit(-shift), "b", "rb").alias("b"))


def repeated_lines(base: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct rows (rid, pos): the lines to delete."""
    one = staged(_repeated(_lines(base), 1), "runs-1")
    levels = {1: one}
    width = 1
    while width * 2 <= min_lines:
        levels[2 * width] = staged(_repeated(_joined(levels[width], levels[width], width), 2 * width), f"runs-{2 * width}")
        width *= 2
    words = one.select("rid", "pos", "words")
    found = None
    for n in range(1, min_lines + 1):
        w = 1 << (n.bit_length() - 1)
        runs = levels[n] if n in levels else _repeated(_joined(levels[w], levels[w], n - w), n)
        runs = runs.where("later").select("rid", "pos", "skip")
        if n < min_lines:
            total = runs.select("rid", "pos", "skip", F.explode(F.sequence(F.col("pos"), F.col("pos") + n - 1)).alias("at"))
            total = total.join(words.withColumnRenamed("pos", "at"), ["rid", "at"]).groupBy("rid", "pos", "skip").agg(F.sum("words").alias("words"))
            runs = total.where(F.col("words") >= min_words).select("rid", "pos", "skip")
        own = runs.where(F.col("skip") < n).select("rid", F.explode(F.sequence(F.col("pos") + F.col("skip"), F.col("pos") + n - 1)).alias("pos"))
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the later copies of repeated runs cut from their texts, and columns __n_lines and __n_removed.

    Null texts stay null with 0 lines; an empty text is one empty line. A text of which all lines go becomes
    empty. Rows that repeat an id are different documents. All other columns stay as they are. Words are
    counted by spaces.
    """
    docs, back = sheltered(docs)
    names = docs.columns
    base = docs.withColumns({"__rid": F.monotonically_increasing_id(), "__id": F.col(f"`{id_col}`"), "__text": F.col(f"`{text_col}`").cast("string")})
    base = staged(base.select(*(f"`{c}`" for c in names if c != text_col), "__rid", "__id", "__text"), "runs-docs")  # rids are fixed once written
    gone = repeated_lines(base, min_lines, min_words).groupBy("rid").agg(F.collect_set("pos").alias("__gone"))
    out = base.join(gone.withColumnRenamed("rid", "__rid"), "__rid", "left")
    lines = F.split("__text", "\n", -1)

    def stays(_: Column, i: Column) -> Column:
        return ~F.array_contains("__gone", i)

    text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    n = F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    return back(out.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names), n.alias("__n_lines"), F.when(F.col("__gone").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("__n_removed")))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document: lines, lines removed, characters and a digest; null texts count as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


ORACLE = {
    "op10_line_runs": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words,
        lead(line) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT *, words + coalesce(length(l2) - length(replace(l2, ' ', '')) + 1, 0) AS words2 FROM w),
f AS (SELECT *, min(o) OVER (PARTITION BY line) AS f1, min(o) OVER (PARTITION BY line, l2) AS f2, min(o) OVER (PARTITION BY line, l2, l3) AS f3
      FROM (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS o, row_number() OVER (ORDER BY doc_id, pos) - pos AS base FROM v)),
-- o numbers all lines; of a window of n lines whose first place is f, in the same document if f > base, lines f..f+n-1 stay
g AS (SELECT doc_id, pos FROM f WHERE f1 < o AND words >= {MIN_WORDS}
      UNION SELECT doc_id, pos + k FROM f, (VALUES (0), (1)) t(k) WHERE l2 IS NOT NULL AND f2 < o AND words2 >= {MIN_WORDS} AND (f2 <= base OR o + k > f2 + 1)
      UNION SELECT doc_id, pos + k FROM f, (VALUES (0), (1), (2)) t(k) WHERE l3 IS NOT NULL AND f3 < o AND (f3 <= base OR o + k > f3 + 2)),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(total.n, 0) AS n_lines, coalesce(total.n, 0) - coalesce(kept.n, 0) AS n_removed,
       CAST(length(coalesce(kept.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN total ON d.doc_id = total.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""",
}
QUERIES = {"op10_line_runs": op10_line_runs}
