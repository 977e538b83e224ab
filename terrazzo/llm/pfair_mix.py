"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in an order drawn by hash, are cut into blocks of `block` documents. A source of weight w
out of W gives its k-th block (from 0) the release time floor(k W / w) and the deadline ceil((k + 1) W / w); slots go
to the released block of earliest deadline (ties: the source named first). Weights are whole numbers, so the
schedule repeats every W slots, each source is always within one block of its share, and no slot stays empty.
When a source has given its last block, the others go on with their weights from a new schedule, so all
documents are placed and none twice. With s sources there are at most s such phases.

One period is worked out per phase from the weights alone, on the driver, as is the length of each phase from
the sources' sizes: at most a row a source and phase. A block's slot then follows from its number by arithmetic.
Ranks within a source come from counts of small hash buckets, so a source with a third of all rows is spread
over as many tasks as any other share of rows. Sources without a weight of their own form one class together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.session import staged

REST = "*"
#: The production mix: shares of 40, of which REST goes to all sources that are not named.
WEIGHTS = {"src0": 12, "src1": 2, "src2": 2, "src3": 2, "src4": 2, "src5": 1, "src6": 1, "src7": 1, "src8": 1, REST: 16}
BLOCK = 16
BUCKET_ROWS = 4_000


def period(weights: list[int]) -> list[int]:
    """Which source has each of the sum(weights) slots: earliest deadline first among released blocks."""
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(weights) if done[i] * total // w <= t]
        _, i = min(ready)
        done[i] += 1
        out.append(i)
    return out


@dataclass(frozen=True)
class Phase:
    """For one class: its blocks first..last-1 fall in this phase; slot = start + (k' // weight) * total + at[k' % weight]."""

    cls: str
    first: int
    last: int
    start: int
    weight: int
    total: int
    at: list[int]


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[Phase]:
    done = dict.fromkeys(weights, 0)
    out, start = [], 0
    while active := [c for c in weights if done[c] < blocks.get(c, 0)]:
        w = [weights[c] for c in active]
        total, slots = sum(w), period(w)
        at = {c: [t for t, i in enumerate(slots) if active[i] == c] for c in active}

        def slot(c: str, k: int) -> int:
            return k // weights[c] * total + at[c][k % weights[c]]  # noqa: B023

        length = min(slot(c, blocks[c] - done[c] - 1) for c in active) + 1
        for c in active:
            n = length // total * weights[c] + sum(t < length % total for t in at[c])
            n = min(n, blocks[c] - done[c])
            if n:
                out.append(Phase(c, done[c], done[c] + n, start, weights[c], total, at[c]))
            done[c] += n
        start += length
    return out


def class_of(source: Column, weights: dict[str, int]) -> Column:
    named = [c for c in weights if c != REST]
    return F.when(source.isin(named), source).otherwise(F.lit(REST)) if named else F.lit(REST)


def mix(docs: DataFrame, weights: dict[str, int], block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """`docs` with __class, __rank, __block, __slot and __position (all from 0) after its own columns.

    __position is the row's place in the whole mix. Null sources and those without a weight share REST,
    which has weight 1 unless named. Rows with null or equal ids are ordered by their hash over all columns;
    rows equal in every column are alike, so their order among themselves doesn't matter. Weights are whole
    numbers above 0, otherwise ValueError. `docs` has no column of those names (common.sheltered sees to that).
    """
    weights = dict(weights)
    weights.setdefault(REST, 1)
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers above 0")
    spark = docs.sparkSession
    plain = [F.col(f"`{c}`") for c in docs.columns]
    wide = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    tie = F.xxhash64(*wide)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("?"), tie.cast("string")))  # null ids spread, too
    rows = docs.withColumns({"__class": class_of(F.col(f"`{source_col}`"), weights), "__key": F.md5(F.concat(F.lit(seed + ":"), ident)), "__tie": tie})
    n = docs.count()
    digits = 1
    while n > BUCKET_ROWS * 16**digits * 2 and digits < 8:
        digits += 1
    rows = rows.withColumn("__bucket", F.left("__key", F.lit(digits)))
    per = staged(rows.groupBy("__class", "__bucket").agg(F.count("*").alias("__n")), "mix-counts")
    sizes = {r["__class"]: r.n for r in per.groupBy("__class").agg(F.sum("__n").alias("n")).collect()}  # a row a class
    blocks = {c: -(-k // block) for c, k in sizes.items()}
    plan = phases(weights, blocks)
    # what the last blocks lack of a full one, by slot: later positions move up by it
    lacks = [(p.start + (p.last - 1 - p.first) // p.weight * p.total + p.at[(p.last - 1 - p.first) % p.weight], blocks[p.cls] * block - sizes[p.cls]) for p in plan if p.last == blocks[p.cls]]
    before = F.sum("__n").over(W.partitionBy("__class").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = per.select("__class", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__class", "__bucket").orderBy("__key", "__tie"))
    ranked = rows.withColumn("__in", within).join(offsets, ["__class", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__in") - 1)
    ranked = ranked.withColumn("__block", F.floor(F.col("__rank") / block))
    table = spark.createDataFrame(
        [(p.cls, p.first, p.last, p.start, p.weight, p.total, p.at) for p in plan] or [(REST, 0, 0, 0, 1, 1, [0])],
        "__of string, __first long, __last long, __start long, __weight int, __total int, __at array<int>",
    )
    k = F.col("__block") - F.col("__first")
    slot = F.col("__start") + F.floor(k / F.col("__weight")) * F.col("__total") + F.element_at("__at", (k % F.col("__weight") + 1).cast("int"))
    placed = ranked.join(F.broadcast(table), (F.col("__class") == F.col("__of")) & (F.col("__first") <= F.col("__block")) & (F.col("__block") < F.col("__last")))
    placed = placed.withColumn("__slot", slot)
    missing = F.lit(0).cast("long")
    for at, lack in lacks:
        if lack:
            missing = missing + F.when(F.col("__slot") > at, lack).otherwise(0)
    position = F.col("__slot") * block + F.col("__rank") % block - missing
    return placed.select(*plain, "__class", "__rank", "__block", "__slot", position.alias("__position"))


def in_order(mixed: DataFrame, columns: list[str], rows_a_part: int = 12_000) -> DataFrame:
    """The mixed rows in their order: part files of a Parquet write follow each other, and so do the rows in them."""
    n = mixed.count()
    parts = max(1, -(-n // rows_a_part))
    at = F.floor(F.col("__position") * parts / F.lit(max(1, n))).cast("int")
    return mixed.withColumn("__part", at).repartitionById(parts, F.col("__part")).sortWithinPartitions("__position").select(*(f"`{c}`" for c in columns))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    m = mix(docs, WEIGHTS)
    return m.select("doc_id", "source", F.col("__class").alias("mix_class"), F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


_NAMED = ", ".join(f"'{c}'" for c in WEIGHTS if c != REST)
_CLASSES = ", ".join(f"({i}, '{c}', {w})" for i, (c, w) in enumerate(WEIGHTS.items(), 1))
ORACLE = {
    # the slots one after another, by the rule itself: no period, no phases table
    "op2_pfair_mix": f"""
WITH RECURSIVE cls(i, c, w) AS (VALUES {_CLASSES}),
d AS (SELECT doc_id, source, CASE WHEN source IN ({_NAMED}) THEN source ELSE '{REST}' END AS c FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5('mix:' || doc_id), doc_id) - 1 AS k FROM d),
n AS (SELECT i, c, w, coalesce((SELECT count(*) FROM d WHERE d.c = cls.c), 0) AS rows FROM cls),
lists AS (SELECT list(w ORDER BY i) AS w, list((rows + {BLOCK - 1}) // {BLOCK} ORDER BY i) AS blocks FROM n),
sim(t, t0, done, base, pick) AS (
  SELECT 0, 0, list_transform(w, lambda x: 0), list_transform(w, lambda x: 0), 0 FROM lists
  UNION ALL
  SELECT t + 1, CASE WHEN done[p] + 1 = blocks[p] THEN t + 1 ELSE t0 END, nd,
         CASE WHEN done[p] + 1 = blocks[p] THEN nd ELSE base END, p
  FROM (SELECT *, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END) AS nd
        FROM (SELECT *, list_sort(list_transform(list_filter(act, lambda i: (done[i] - base[i]) * tot // w[i] <= t - t0),
                lambda i: [((done[i] - base[i] + 1) * tot + w[i] - 1) // w[i], i]))[1][2] AS p
              FROM (SELECT *, list_sum(list_transform(act, lambda i: w[i]))::BIGINT AS tot
                    FROM (SELECT sim.*, w, blocks, list_filter(range(1, len(w) + 1), lambda i: done[i] < blocks[i]) AS act FROM sim, lists)
                    WHERE len(act) > 0)))),
slots AS (SELECT t - 1 AS slot, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block FROM sim WHERE t > 0)
SELECT doc_id, source, r.c AS mix_class, k // {BLOCK} AS block, CAST(slot AS BIGINT) AS slot,
       row_number() OVER (ORDER BY slot, k) - 1 AS position
FROM r JOIN cls ON r.c = cls.c JOIN slots ON slots.pick = cls.i AND slots.block = k // {BLOCK}""",
}
QUERIES = {"op2_pfair_mix": op2_pfair_mix}
