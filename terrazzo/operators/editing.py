"""An editing session over keyed collections: change sets, the state they give, a gate, and saving.

A session never changes its tables in place. Every edit proposes a new change set; the gate looks at the state it
would give, and only then is it kept. So a refused edit leaves no trace, and a saved session is a set of small change
files beside an untouched base.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.operators import merge as M
from terrazzo.operators import quality as Q
from terrazzo.session import staged
from terrazzo.sources import files

CHANGE = "ord long, op string, fields map<string,string>"


@dataclass
class Collection:
    """base: key, columns and ord; rules: functions of the current rows (text columns) to rule columns."""

    base: DataFrame
    key: str
    columns: list[str]
    rules: Callable[[], list[Column]] = list
    references: list[Q.Reference] = field(default_factory=list)


class Refused(ValueError):
    """An edit that the gate did not let through."""


class Session:
    """API1-API6, R41-R48, A19: create, update, delete, current, diff, report and save by collection name."""

    def __init__(self, collections: dict[str, Collection], gate: Callable[[dict[str, DataFrame]], DataFrame] | None = None):
        self.of, self.gate, self.version, self.next_ord = collections, gate, 0, 0
        self.changes: dict[str, DataFrame] = {}

    def _spark(self):
        return next(iter(self.of.values())).base.sparkSession

    def pending(self, name: str) -> DataFrame:
        c = self.of[name]
        kind = c.base.schema[c.key].dataType.simpleString()
        return self.changes.get(name, self._spark().createDataFrame([], f"`{c.key}` {kind}, {CHANGE}"))

    def current(self, name: str) -> DataFrame:
        """The rows as they are now: text columns with ord."""
        c = self.of[name]
        return M.apply_overrides(c.base, self.pending(name), c.key, c.columns)

    def diff(self, name: str) -> DataFrame:
        c = self.of[name]
        return M.diff_overrides(c.base, self.current(name), c.key, c.columns)

    def report(self) -> DataFrame:
        """A row a collection: (collection, edited, added, deleted, orphans, duplicates, new_in_base)."""
        out = None
        for name, c in self.of.items():
            r = M.merge_report(c.base, self.pending(name), c.key, c.columns).withColumn("collection", F.lit(name))
            out = r if out is None else out.unionByName(r)
        return out

    def _propose(self, name: str, op: str, rows: DataFrame) -> None:
        c = self.of[name]
        known = [x for x in rows.columns if x != c.key]
        if unknown := sorted(set(known) - set(c.columns)):
            raise Refused(f"{name} has no column {', '.join(unknown)}")
        fields = F.create_map(*(x for k in known for x in (F.lit(k), F.col(f"`{k}`").cast("string")))) if known else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        change = rows.select(F.col(c.key), (F.lit(self.next_ord) + F.monotonically_increasing_id()).alias("ord"), F.lit(op).alias("op"), fields.alias("fields"))
        before = self.changes.get(name)
        self.changes[name] = staged(self.pending(name).unionByName(change), f"changes-{name}")
        try:
            if problem := self.problems(name).first():
                raise Refused(f"{name} {problem[0]}: {problem[1]}")
            if self.gate is not None and (found := self.gate({n: self.current(n) for n in self.of}).first()):
                raise Refused(", ".join(map(str, found)))
        except Refused:
            if before is None:
                del self.changes[name]
            else:
                self.changes[name] = before
            raise
        self.version += 1
        self.next_ord += 1 << 50

    def problems(self, name: str) -> DataFrame:
        """The first problem of each current row."""
        c = self.of[name]
        return Q.first_problem(self.current(name), c.key, c.rules(), c.references)

    def create(self, name: str, rows: DataFrame) -> None:
        """New records; keys that are there already are refused."""
        there = rows.join(self.current(name), self.of[name].key, "left_semi").first()
        if there is not None:
            raise Refused(f"{name} {there[self.of[name].key]} is there already")
        self._propose(name, "new", rows)

    def update(self, name: str, rows: DataFrame) -> None:
        """The given columns of records that are there; null clears."""
        lost = rows.join(self.current(name), self.of[name].key, "left_anti").first()
        if lost is not None:
            raise Refused(f"{name} {lost[self.of[name].key]} isn't there")
        self._propose(name, "edit", rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        self._propose(name, "delete", keys.select(self.of[name].key))

    def save(self, folder: str) -> dict[str, bool]:
        """Each collection's diff as a table, written only if its content changed."""
        out = {}
        for name in self.of:
            d = self.diff(name).select(F.col(self.of[name].key), "op", F.to_json("fields").alias("fields"))
            out[name] = files.write_if_changed(d, f"{folder}/{name}")
        return out
