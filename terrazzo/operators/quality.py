"""Data-quality rules as DataFrames of findings. A rule is a name and a column that is its message or null.

`first_problem` gives each row's first finding, `all_problems` a row for each; referential rules are anti joins.
Nothing raises unless `require` is asked to, and that only once the plan runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.functions.text import number_of, text
from terrazzo.session import broadcast_if

#: More patterns than these are not broadcast.
MAX_PATTERNS = 10_000


def blank(c: Column) -> Column:
    return F.trim(text(c)) == ""


def one_of(name: str, c: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(~blank(c) & ~c.isin(*allowed), F.concat(F.lit(f"{name} must be {', '.join(allowed[:-1])} or {allowed[-1]} (got "), text(c), F.lit(")")))


def number_in(name: str, c: Column, low: float | None = None, high: float | None = None) -> Column:
    """P20: a number when present, in a range when there is one."""
    n = number_of(c)
    out = F.when(~blank(c) & n.isNull(), F.concat(F.lit(f"{name} must be a number (got "), text(c), F.lit(")")))
    if low is not None:
        out = F.coalesce(out, F.when((n < low) | (n > high), F.concat(F.lit(f"{name} must be from {low:g} to {high:g} (got "), text(c), F.lit(")"))))
    return out


def required(name: str, c: Column) -> Column:
    """P23, R44."""
    return F.when(blank(c), f"{name} is required")


def matches(name: str, c: Column, pattern: str, what: str) -> Column:
    return F.when(~F.coalesce(c.rlike(pattern), F.lit(False)), f"{name} must be {what}")


def differ(a: Column, b: Column, message: str) -> Column:
    """P20: the two must not be the same."""
    return F.when(~blank(a) & (text(a) == text(b)), message)


def longest(name: str, c: Column, most: int) -> Column:
    """A text of at most so many characters."""
    return F.when(F.length(text(c)) > most, f"{name} is longer than {most} characters")


def polygon(c: Column) -> Column:
    """JSON text of three or more pairs of numbers; blank is fine."""
    ring = F.from_json(c, "array<array<double>>")
    ok = (F.size(ring) >= 3) & F.forall(ring, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.when(~blank(c) & ~F.coalesce(ok, F.lit(False)), "polygon must be three or more pairs of numbers")


def ring_problem(ring: Column, area: Column) -> Column:
    """P25: four or more positions, closed, three distinct, with an area."""
    n = F.size(F.array_distinct(ring))
    return (
        F.when(F.size(ring) < 4, "a ring needs four positions")
        .when(F.element_at(ring, 1) != F.element_at(ring, -1), "a ring must end where it begins")
        .when(n < 3, "a ring needs three distinct positions")
        .when(F.abs(area) == 0, "a ring needs an area")
    )


def position_problem(lng: Column, lat: Column) -> Column:
    """P25."""
    return F.when(lng.isNull() | lat.isNull() | F.isnan(lng) | F.isnan(lat), "a position needs two numbers").when(~lng.between(-180, 180) | ~lat.between(-90, 90), "a position must be on the earth")


@dataclass(frozen=True)
class Reference:
    """column of the checked rows must be a key of table `frame`."""

    column: str
    frame: DataFrame
    key: str
    name: str


def with_references(rows: DataFrame, references: list[Reference]) -> tuple[DataFrame, list[Column]]:
    """Rows joined to the keys they name, and one message column a reference."""
    out, found = rows, []
    for i, r in enumerate(references):
        keys = r.frame.select(F.col(r.key).alias(f"__k{i}")).distinct()
        out = out.join(keys, F.col(r.column) == F.col(f"__k{i}"), "left")
        found.append(F.when(~blank(F.col(r.column)) & F.col(f"__k{i}").isNull(), F.concat(F.lit(f"{r.column} names no {r.name}: "), text(F.col(r.column)))))
    return out, found


def first_problem(rows: DataFrame, key: str, rules: list[Column], references: list[Reference] = ()) -> DataFrame:
    """(key, problem) of rows with one, by the order of the rules; references come last."""
    joined, refs = with_references(rows, list(references))
    return joined.select(key, F.coalesce(*rules, *refs, F.lit(None).cast("string")).alias("problem")).where("problem is not null")


def all_problems(rows: DataFrame, key: str, rules: list[Column], references: list[Reference] = ()) -> DataFrame:
    """(key, problem), a row for every broken rule."""
    joined, refs = with_references(rows, list(references))
    found = F.array_compact(F.array(*rules, *refs, F.lit(None).cast("string")))
    return joined.select(key, F.explode(found).alias("problem"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, problem) of blank and repeated keys."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    message = F.when(blank(F.col(key)), "id is blank").when(F.col("n") > 1, F.concat(F.lit("id occurs "), F.col("n").cast("string"), F.lit(" times")))
    return n.select(key, message.alias("problem")).where("problem is not null")


def change_problems(changes: DataFrame, key: str) -> DataFrame:
    """(ord, problem) of change records without a key, with an unknown op, or new and deleted at once in one place."""
    w = W.partitionBy(key, "ord")
    both = F.size(F.collect_set("op").over(w)) > 1
    message = F.when(blank(F.col(key)), "a change needs a key").when(~F.coalesce(F.col("op").isin("edit", "new", "delete"), F.lit(False)), "op must be edit, new or delete").when(both, "a change can't be two things at once")
    return changes.select("ord", message.alias("problem")).where("problem is not null").distinct()


def schema_diff(have: list[str], want: list[str]) -> list[str]:
    """Differences of two header lists as lines."""
    out = [f"missing column {c}" for c in want if c not in have] + [f"unknown column {c}" for c in have if c not in want]
    return out or ([] if have == want else ["columns are in another order"])


def leaks(texts: DataFrame, key: str, column: str, patterns: DataFrame) -> DataFrame:
    """(key, pattern) where a text holds one of the few guarded patterns (broadcast: a list kept by hand)."""
    return texts.join(broadcast_if(patterns, patterns.count(), MAX_PATTERNS), F.expr(f"{column} rlike pattern")).select(key, "pattern")


#: Root-relative addresses: in src, href and action, in calls of fetch and open, and as quoted data paths.
ROOT_RELATIVE = r"""\b(?:src|href|action)\s*=\s*["']/(?:[^/"'][^"']*)?["']|\b(?:fetch|open)\(\s*["']/(?:[^/"'][^"']*)?["']|["']/(?:data|floors|config\.json)\b[^"']*["']"""


def root_relative(html: Column) -> Column:
    """The places of a page that name a root-relative address."""
    return F.regexp_extract_all(html, F.lit(ROOT_RELATIVE), F.lit(0))


def require(problems: DataFrame) -> DataFrame:
    """The one row (n) of a check that found nothing; a finding raises when the plan runs."""
    n = problems.agg(F.count("*").alias("n"), F.min("problem").alias("p"))
    return n.select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit("check failed: "), F.col("p"))).cast("long")).otherwise(F.col("n")).alias("n"))
