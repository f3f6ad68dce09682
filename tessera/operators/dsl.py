"""JSON queries: a chain of foreign-key joins with filters, projection or aggregates, sort and limit."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import conjunction
from tessera.operators.calculus import aggregated, ordered
from tessera.plans.catalog import Catalog, Table

FIELDS = ("from", "filter", "join", "select", "group_by", "aggregate", "sort", "limit")
FUNCTIONS = ("count", "sum", "avg", "min", "max")


def _list(spec: dict, name: str) -> list:
    value = spec.get(name) or []
    if not isinstance(value, list):
        raise TypeError(f"{name} is a list")
    return value


class Query:
    """A parsed and bound query. Filters hold on the first table; a column name means the first table of the chain that has it."""

    def __init__(self, catalog: Catalog, spec: dict):
        if not isinstance(spec, dict) or not isinstance(spec.get("from"), str):
            raise ValueError("a query names its first table in 'from'")
        if unknown := set(spec) - set(FIELDS):
            raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
        self.catalog, self.chain, self.hops = catalog, [catalog.table(spec["from"])], []
        for j in _list(spec, "join"):
            label = j.get("via_edge") if isinstance(j, dict) else j
            if not isinstance(label, str):
                raise TypeError("a join names its edge in 'via_edge'")
            hop = catalog.hop(self.chain[-1].name, label)
            self.hops.append(hop)
            self.chain.append(catalog.table(hop.dest))
        self.filter = _list(spec, "filter")
        self.select, self.group_by, self.aggregates = _list(spec, "select"), _list(spec, "group_by"), _list(spec, "aggregate")
        if self.select and self.aggregates:
            raise ValueError("select and aggregate exclude each other")
        if self.group_by and not self.aggregates:
            raise ValueError("group_by needs aggregate")
        if len({*self.select}) < len(self.select) or len({*self.group_by}) < len(self.group_by):
            raise ValueError("a column is named twice")
        for a in self.aggregates:
            self._check_aggregate(a)
        aliases = [a["alias"] for a in self.aggregates]
        if len({*aliases, *self.group_by}) < len(aliases) + len(self.group_by):
            raise ValueError("two outputs have one name")
        self.outputs = [*self.group_by, *aliases] if self.aggregates else self.select or list(self.chain[-1].names)
        self.sort = [self._check_sort(s) for s in _list(spec, "sort")]
        self.limit = spec.get("limit")
        if self.limit is not None and (isinstance(self.limit, bool) or not isinstance(self.limit, int) or self.limit < 1):
            raise ValueError("limit is a positive integer")
        for c in (*self.select, *self.group_by):
            self.find(c)

    def _check_aggregate(self, a: Any) -> None:
        if not isinstance(a, dict) or not isinstance(a.get("alias"), str) or not a["alias"] or a.get("fn") not in FUNCTIONS:
            raise ValueError(f"an aggregate has an alias and fn, one of {', '.join(FUNCTIONS)}")
        if a.get("column") is not None:
            self.find(a["column"])
        elif a["fn"] != "count":
            raise ValueError(f"{a['fn']} needs a column")

    def _check_sort(self, s: Any) -> tuple[str, bool]:
        if not isinstance(s, dict) or not isinstance(s.get("column"), str) or s.get("direction", "asc") not in ("asc", "desc"):
            raise ValueError("a sort has column and direction asc or desc")
        if self.aggregates:
            if s["column"] not in self.outputs:
                raise ValueError(f"{s['column']} is neither an alias nor in group_by")
        else:
            self.find(s["column"])
        return s["column"], s.get("direction", "asc") == "desc"

    def find(self, column: str) -> tuple[int, Table]:
        for k, t in enumerate(self.chain):
            if column in t.names:
                return k, t
        raise KeyError(f"no table of the chain has a column {column!r}")

    def _col(self, column: str) -> Column:
        return F.col(f"t{self.find(column)[0]}.{column}")

    def frame(self, frames: Callable[[str], DataFrame]) -> DataFrame:
        first = self.chain[0]
        df = frames(first.name).where(conjunction(first, self.filter)).alias("t0") if self.filter else frames(first.name).alias("t0")
        for k, hop in enumerate(self.hops):
            df = df.join(frames(hop.dest).alias(f"t{k + 1}"), F.col(f"t{k}.{hop.origin_column}") == F.col(f"t{k + 1}.{hop.dest_column}"))
        if self.aggregates:
            out = [self._aggregate(a).alias(a["alias"]) for a in self.aggregates]
            df = df.groupBy(*(self._col(c).alias(c) for c in self.group_by)).agg(*out) if self.group_by else df.agg(*out)
            if self.sort:
                df = df.orderBy(*(ordered(c, d) for c, d in self.sort))
            df = df.select(*self.outputs)
        else:
            last = len(self.chain) - 1
            if self.sort:
                df = df.orderBy(*(ordered(self._col(c), d) for c, d in self.sort))
            df = df.select(*((self._col(c) if self.select else F.col(f"t{last}.{c}")).alias(c) for c in self.outputs))
        return df.limit(self.limit) if self.limit else df

    def _aggregate(self, a: dict) -> Column:
        if a.get("column") is None:
            return F.count("*")
        c = self._col(a["column"])
        return F.count(c) if a["fn"] == "count" else aggregated(c, a["fn"], self.find(a["column"])[1].type_of(a["column"]))


def query(catalog: Catalog, frames: Callable[[str], DataFrame], spec: dict) -> DataFrame:
    return Query(catalog, spec).frame(frames)


def answer(catalog: Catalog, frames: Callable[[str], DataFrame], spec: dict, most: int = 1_000) -> dict:
    """columns, rows and row_count, collected; of a query without a lower limit the first `most` rows, and whether there are more."""
    df = query(catalog, frames, spec)
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    return {"columns": df.columns, "rows": rows[:most], "row_count": len(rows[:most]), "truncated": len(rows) > most}
