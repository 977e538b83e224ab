"""Keyed merge of sparse change sets, its inverse, and the set operations around it.

A base table has a key and value columns; their order is kept in an explicit order column. A change set has the
key, `ord` (place in its file), `op` ('edit', 'new' or 'delete') and `fields`, a map of column name to new text
value; absent fields stay, null ones clear. Values are compared and stored as text, so any table can be merged by
casting its columns. A key's changes are folded in file order inside one row, after one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANK = ""
STATE = "struct<live:boolean,was:boolean,row:map<string,string>,edited:bigint,added:bigint,deleted:bigint,orphans:array<struct<ord:bigint,op:string>>,new_in_base:bigint>"


def _as_map(columns: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(f"`{c}`").cast("string") for c in columns)))


def fold(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: its order, final state, counts and orphans; the common part of J01 and its reports."""
    b = base.select(F.col(key).alias("key"), F.col("ord").alias("base_ord"), _as_map(columns).alias("row"))
    change = F.struct("ord", "op", F.map_filter("fields", lambda k, _: k.isin(columns)).alias("fields"))
    c = changes.select(F.col(key).alias("key"), change.alias("c"))
    # maps don't sort, so the list is ordered by its ord alone
    c = c.groupBy("key").agg(F.collect_list("c").alias("cs"))
    c = c.withColumn("cs", F.array_sort("cs", lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)))
    both = b.join(c, "key", "full_outer")
    blank = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array_repeat(F.lit(BLANK), len(columns)))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.col("base_ord").isNotNull().alias("live"),
        F.col("base_ord").isNotNull().alias("was"),
        F.coalesce("row", blank).alias("row"),
        *(zero.alias(n) for n in ("edited", "added", "deleted")),
        F.array().cast("array<struct<ord:bigint,op:string>>").alias("orphans"),
        zero.alias("new_in_base"),
    )

    def over(row: Column, fields: Column) -> Column:
        return F.map_zip_with(row, fields, lambda k, old, new: F.when(F.map_contains_key(fields, k), new).otherwise(old))

    def step(s: Column, x: Column) -> Column:
        live, op = s["live"], x["op"]
        orphan = ~live & op.isin("edit", "delete")
        row = F.when(op == "delete", s["row"]).when((op == "new") & ~live, over(blank, x["fields"])).when(live, over(s["row"], x["fields"])).otherwise(s["row"])
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            F.when(op == "new", True).when(op == "delete", False).otherwise(live).alias("live"),
            (s["was"] | (op == "new")).alias("was"),
            row.alias("row"),
            (s["edited"] + one(live & (op == "edit"))).alias("edited"),
            (s["added"] + one(op == "new")).alias("added"),
            (s["deleted"] + one(live & (op == "delete"))).alias("deleted"),
            F.when(orphan, F.array_append(s["orphans"], F.struct(x["ord"].cast("long").alias("ord"), op.alias("op")))).otherwise(s["orphans"]).alias("orphans"),
            (s["new_in_base"] + one(live & (op == "new") & F.col("base_ord").isNotNull())).alias("new_in_base"),
        )

    none = F.array().cast(c.schema["cs"].dataType)
    state = F.aggregate(F.coalesce("cs", none), start.cast(STATE), lambda s, x: step(s, x).cast(STATE))
    first = F.get(F.filter(F.coalesce("cs", none), lambda x: x["op"] == "new"), F.lit(0))["ord"]
    return both.select("key", "base_ord", first.alias("new_ord"), F.size(F.coalesce("cs", none)).alias("n_changes"), state.alias("s"))


def apply_overrides(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The merged table as text columns with `ord`: base order, then added keys in file order.

    A new record over a live one edits it; over a deleted one it starts from blanks in the old place. Edits and
    deletes of keys that aren't live change nothing (see merge_report). Empty tables on either side are fine.
    """
    live = fold(base, changes, key, columns).where("s.live")
    place = F.coalesce(F.col("base_ord"), F.lit(1 << 40) + F.col("new_ord"))
    return live.select(F.col("key").alias(key), *(F.col("s.row")[c].alias(c) for c in columns), place.alias("ord"))


def merge_report(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of edits, additions, deletions, orphans, duplicate keys, and new keys found in the base."""
    f = fold(base, changes, key, columns)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return f.agg(
        total("s.edited").alias("edited"),
        total("s.added").alias("added"),
        total("s.deleted").alias("deleted"),
        total(F.size("s.orphans")).alias("orphans"),
        total(F.greatest(F.col("n_changes") - 1, F.lit(0))).alias("duplicates"),
        total("s.new_in_base").alias("new_in_base"),
    )


def orphan_records(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The change records that found no live key, verbatim."""
    o = fold(base, changes, key, columns).select(F.col("key").alias(key), F.explode("s.orphans").alias("o")).select(key, F.col("o.ord").alias("ord"))
    return changes.join(o, [key, "ord"], "left_semi")


def diff_overrides(base: DataFrame, current: DataFrame, key: str, columns: list[str], keep: DataFrame | None = None) -> DataFrame:
    """The change set (key, op, fields) that makes `current` of `base`; apply_overrides is its inverse.

    Unchanged keys have no row; null and blank are the same value. Rows of `keep` are carried along.
    """
    b = base.select(F.col(key), F.lit(True).alias("in_b"), _as_map(columns).alias("b"))
    c = current.select(F.col(key), F.lit(True).alias("in_c"), _as_map(columns).alias("c"))
    both = b.join(c, key, "full_outer")
    val = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(BLANK))
    changed = F.map_filter("c", lambda k, v: F.coalesce(v, F.lit(BLANK)) != val(F.col("b"), k))
    op = F.when(F.col("in_c").isNull(), "delete").when(F.col("in_b").isNull(), "new").otherwise("edit")
    fields = F.when(op == "new", F.col("c")).when(op == "edit", changed).otherwise(F.map_filter("b", lambda k, v: F.lit(False)))
    out = both.select(key, op.alias("op"), fields.alias("fields")).where((F.col("op") != "edit") | (F.size("fields") > 0))
    return out if keep is None else out.unionByName(keep.select(key, "op", "fields"))


def ignored_fields(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field) of fields that the table doesn't have."""
    return changes.select(key, F.explode(F.map_keys(F.map_filter("fields", lambda k, _: ~k.isin(columns)))).alias("field"))


def last_wins(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """The union of tables with one row a key, that of the last table, then of the greatest order value."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("__i", F.lit(i))
        out = f if out is None else out.unionByName(f)
    w = W.partitionBy(*keys).orderBy(F.col("__i").desc(), F.col(order).desc())
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__i")


def insert_missing(rows: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`rows` and those of `new` whose keys (nulls equal) aren't there yet, the first of each."""
    cond = None
    other = rows.select(*(F.col(k).alias(f"__{k}") for k in keys))
    for k in keys:
        c = new[k].eqNullSafe(other[f"__{k}"])
        cond = c if cond is None else cond & c
    fresh = new.join(other, cond, "left_anti")
    w = W.partitionBy(*keys).orderBy(order)
    return rows.unionByName(fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))


def set_one(rows: DataFrame, edit: DataFrame, key: str, value: str) -> DataFrame:
    """One value a key: rows of `edit` replace, or with a null value remove, what is there."""
    kept = rows.join(edit.select(key), key, "left_anti")
    return kept.unionByName(edit.where(F.col(value).isNotNull()).select(*rows.columns))


def reclassify(edges: DataFrame, entries: DataFrame, key: str, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """Edges whose key has a valid entry take its value; all others keep theirs."""
    e = entries.where(F.col(value).isin(*allowed)).select(F.col(key), F.col(value).alias("__v"))
    return edges.join(e, key, "left").withColumn(value, F.coalesce("__v", value)).drop("__v")


def reclassify_report(edges: DataFrame, entries: DataFrame, key: str, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """Each entry with its status: invalid, unknown (no such edge) or applied."""
    known = edges.select(key).distinct().withColumn("__known", F.lit(True))
    status = F.when(~F.coalesce(F.col(value).isin(*allowed), F.lit(False)), "invalid").when(F.col("__known").isNull(), "unknown").otherwise("applied")
    return entries.join(known, key, "left").select(*entries.columns, status.alias("status"))


def effective(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Rows of `edits` replace those of their key, drop them where `drop` is true, and follow otherwise.

    Order is that of `rows`, then that of `edits`, in column ord.
    """
    e = edits.select(key, *(F.col(c).alias(f"__{c}") for c in rows.columns if c != key), F.col("drop").alias("__drop"), F.lit(True).alias("__e"))
    both = rows.withColumn("__r", F.lit(True)).join(e, key, "full_outer").where(~F.coalesce("__drop", F.lit(False)))
    cols = [F.when(F.col("__e").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns if c not in (key, "ord")]
    place = F.when(F.col("__r").isNotNull(), F.col("ord")).otherwise(F.lit(1 << 40) + F.col("__ord"))
    return both.select(key, *cols, place.alias("ord"))


def delete_cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str, ends: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes without `gone`'s keys, and edges without an end among them."""
    out = edges
    for end in ends:
        out = out.join(gone.select(F.col(key).alias(end)), end, "left_anti")
    return nodes.join(gone.select(key), key, "left_anti"), out.select(*edges.columns)


def next_suffix(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """the next free number after ids of the form prefix<number>; 1 if there are none."""
    n = F.regexp_extract(F.col(column), f"^{prefix}(\\d+)$", 1)
    return ids.where(F.col(column).startswith(prefix) & (n != "")).agg((F.coalesce(F.max(n.try_cast("long")), F.lit(0)) + 1).alias("next"))


def stable_ids(rows: DataFrame, previous: DataFrame, natural: list[str], order: str) -> DataFrame:
    """Rows with an `id`: that of the same occurrence of their natural key before, else numbers on from the
    greatest id, by `order`.

    `previous` has natural, order and id. New rows are numbered by ranges, not in one task: their count per
    hash range of the order value is added up first.
    """
    w = W.partitionBy(*natural).orderBy(order)
    old = previous.withColumn("__n", F.row_number().over(W.partitionBy(*natural).orderBy("id"))).select(*natural, "__n", "id")
    top = previous.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    met = rows.withColumn("__n", F.row_number().over(w)).join(old, [*natural, "__n"], "left")
    fresh = numbered(met.where("id is null").drop("id", "__n"), order).join(F.broadcast(top)).withColumn("id", F.col("__row") + F.col("__top")).drop("__row", "__top")
    return met.where("id is not null").drop("__n").select(*rows.columns, "id").unionByName(fresh.select(*rows.columns, "id"))


def numbered(rows: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """`rows` with `__row`, their number from 1 by the distinct numbers in `order`, without a single-task sort.

    Equal-width ranges of the order value are numbered on their own; the ranges' counts give the offsets.
    """
    span = rows.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    at = F.floor((F.col(order) - F.col("__lo")) * F.lit(ranges) / (F.col("__hi") - F.col("__lo") + 1)).cast("int")
    r = rows.join(F.broadcast(span)).withColumn("__b", at).drop("__lo", "__hi")
    before = F.coalesce(F.sum("__c").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = r.groupBy("__b").agg(F.count("*").alias("__c")).select("__b", before.alias("__before"))
    n = F.row_number().over(W.partitionBy("__b").orderBy(order))
    return r.withColumn("__row", n).join(F.broadcast(counts), "__b").withColumn("__row", F.col("__row") + F.col("__before")).drop("__b", "__before")
