"""The JSON tools over a graph: nine for the calculus and five for exploration, with error envelopes and JSON schemas."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tessera.functions.predicates import OPERATORS
from tessera.operators import dsl, explore
from tessera.operators.calculus import AGGREGATES, Calculus
from tessera.operators.drafts import plain
from tessera.plans.catalog import Catalog

NAMES = ("rows_where", "rows_via", "intersect", "order_by", "take", "count", "aggregate", "group_top", "read", "schema_map", "profile", "sample", "neighborhood", "query")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Toolbox:
    """Tools by name: each takes a dict, or JSON of one, and returns JSON. log gets (name, arguments, answer) of each call."""

    def __init__(self, catalog: Catalog, frames: Callable[[str], DataFrame], log: Callable[[str, Any, str], None] | None = None):
        self.catalog, self.frames, self.calculus, self.log = catalog, frames, Calculus(catalog, frames), log

    def call(self, name: str, arguments: dict | str) -> str:
        """An error of the request comes back as {error, error_type}."""
        try:
            given = json.loads(arguments) if isinstance(arguments, str) else arguments
            if not isinstance(given, dict):
                raise TypeError("arguments are a JSON object")
            if name not in NAMES:
                raise KeyError(f"unknown tool {name!r}")
            out = json.dumps(plain(getattr(self, f"_{name}")(**given)), default=str, ensure_ascii=False)
        except Exception as e:  # every failure is an answer to the caller
            out = json.dumps({"error": str(e), "error_type": type(e).__name__}, ensure_ascii=False)
        if self.log:
            self.log(name, arguments, out)
        return out

    def _rows_where(self, table: str, column: str, op: str, value: Any) -> dict:
        return {"cursor": self.calculus.rows_where(table, column, op, value)}

    def _rows_via(self, cursor: str, edge: str) -> dict:
        return {"cursor": self.calculus.rows_via(cursor, edge)}

    def _intersect(self, left: str, right: str) -> dict:
        return {"cursor": self.calculus.intersect(left, right)}

    def _order_by(self, cursor: str, column: str, direction: str = "asc") -> dict:
        return {"cursor": self.calculus.order_by(cursor, column, direction)}

    def _take(self, cursor: str, n: int) -> dict:
        return {"rows": [list(r.values()) if len(r) > 1 else next(iter(r.values())) for r in _rows(self.calculus.take(cursor, n))]}

    def _count(self, cursor: str) -> dict:
        return {"count": _rows(self.calculus.count(cursor))[0]["cnt"]}

    def _aggregate(self, cursor: str, fn: str, column: str) -> dict:
        return {"value": _rows(self.calculus.aggregate(cursor, fn, column))[0]["agg"]}

    def _group_top(self, cursor: str, group_column: str, fn: str, n: int, agg_column: str | None = None) -> dict:
        return {"groups": _rows(self.calculus.group_top(cursor, group_column, fn, n, agg_column))}

    def _read(self, table: str, row_id: Any, columns: list[str]) -> dict:
        return self.calculus.read_one(table, row_id, columns)

    def _schema_map(self, root_table: str | None = None, depth: int = 2) -> dict:
        return explore.schema_map(self.catalog, root_table, self._number("depth", depth, 0))

    def _profile(self, table: str, column: str | None = None, top_k: int = 5, predicate: list[dict] | None = None) -> dict:
        if column is None:
            return {"columns": _rows(explore.profile_table(self.catalog, self.frames, table, predicate or []))}
        return _rows(explore.profile_column(self.catalog, self.frames, table, column, predicate or []))[0] | {"top": _rows(explore.top_values(self.catalog, self.frames, table, column, self._number("top_k", top_k), predicate or []))}

    @staticmethod
    def _number(name: str, n: Any, least: int = 1) -> int:
        if isinstance(n, bool) or not isinstance(n, int) or n < least:
            raise ValueError(f"{name} is an integer of {least} or more")
        return n

    def _sample(self, table: str, n: int = 5, seed: int | None = None, predicate: list[dict] | None = None) -> dict:
        return {"rows": _rows(explore.sample(self.catalog, self.frames, table, self._number("n", n), seed, predicate or []))}

    def _neighborhood(self, table: str, row_id: Any, depth: int = 1, max_per_edge: int = 5) -> dict:
        if depth != 1:
            raise ValueError("depth is 1")
        self._number("max_per_edge", max_per_edge)
        key = self.catalog.table(table).key
        anchor = self.calculus.read_one(table, row_id, list(self.catalog.table(table).names))
        return {"anchor": anchor, "key": list(key), "edges": _rows(explore.neighborhood(self.catalog, self.frames, table, row_id, max_per_edge))}

    def _query(self, spec: dict) -> dict:
        return dsl.answer(self.catalog, self.frames, spec)

    def schemas(self) -> dict[str, dict]:
        """JSON schemas of the arguments, with the catalog's names as enums."""
        tables = {"type": "string", "enum": [t.name for t in self.catalog.tables]}
        columns = {"type": "string", "enum": sorted({c for t in self.catalog.tables for c in t.names})}
        edges = {"type": "string", "enum": [x for e in self.catalog.edges for x in (e.forward, e.reverse)]}
        text, few, any_ = {"type": "string"}, {"type": "integer", "minimum": 2, "maximum": 5}, {}
        clauses = {"type": "array", "items": {"type": "object", "properties": {"column": columns, "op": {"enum": list(OPERATORS)}, "value": any_}, "required": ["column", "op", "value"]}}
        shape = {
            "rows_where": ({"table": tables, "column": columns, "op": {"enum": list(OPERATORS)}, "value": any_}, 4),
            "rows_via": ({"cursor": text, "edge": edges}, 2),
            "intersect": ({"left": text, "right": text}, 2),
            "order_by": ({"cursor": text, "column": columns, "direction": {"enum": ["asc", "desc"]}}, 2),
            "take": ({"cursor": text, "n": few}, 2),
            "count": ({"cursor": text}, 1),
            "aggregate": ({"cursor": text, "fn": {"enum": list(AGGREGATES)}, "column": columns}, 3),
            "group_top": ({"cursor": text, "group_column": columns, "fn": {"enum": ["count", *AGGREGATES]}, "n": few, "agg_column": columns}, 4),
            "read": ({"table": tables, "row_id": any_, "columns": {"type": "array", "items": columns, "minItems": 1}}, 3),
            "schema_map": ({"root_table": tables, "depth": {"type": "integer", "minimum": 0}}, 0),
            "profile": ({"table": tables, "column": columns, "top_k": {"type": "integer"}, "predicate": clauses}, 1),
            "sample": ({"table": tables, "n": {"type": "integer"}, "seed": {"type": "integer"}, "predicate": clauses}, 1),
            "neighborhood": ({"table": tables, "row_id": any_, "depth": {"const": 1}, "max_per_edge": {"type": "integer"}}, 2),
            "query": ({"spec": {"type": "object"}}, 1),
        }
        return {n: {"type": "object", "properties": p, "required": list(p)[:k], "additionalProperties": False} for n, (p, k) in shape.items()}
