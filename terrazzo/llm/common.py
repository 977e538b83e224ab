"""Column expressions shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates the words of n-gram operators: all of ASCII but digits and letters (after lower-casing).
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column, gap: str = WORD_GAP) -> Column:
    """The words between gaps, without empty ones."""
    return F.array_remove(F.split(lower_ascii(text), gap), "")


def text_key(text: Column) -> Column:
    """A digest that equal texts share; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so further or clashing columns can't interfere."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def sheltered(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with columns that begin with two underscores, as working columns do, under other names; and what
    gives a result its names back. So no column of a table can clash with an operator's own."""
    safe = [f"extra {i} {c}" if c.startswith("__") else c for i, c in enumerate(df.columns)]
    names = dict(zip(safe, df.columns, strict=True))

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in out.columns))

    return (df, lambda out: out) if safe == df.columns else (df.toDF(*safe), back)


def bucket_of(value: Column, cuts: list) -> Column:
    """How many of the sorted `cuts` lie below `value`, as an int: two short searches, of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    tops = F.array(*(F.lit(g[-1]) for g in groups))
    at = F.size(F.filter(tops, lambda c: c < value))
    within = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.least(at + 1, F.lit(len(groups))))
    inside = F.size(F.filter(within, lambda c: c < value))
    return F.when(at == len(groups), len(cuts)).otherwise(at * step + inside).cast("int")
