"""The seven comparison operators, as Catalyst expressions over typed values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.values import coerce
from tessera.plans.catalog import Table

COMPARISONS = {"eq": lambda c, v: c == v, "lt": lambda c, v: c < v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "gte": lambda c, v: c >= v}
OPERATORS = (*COMPARISONS, "in", "like")


def check(table: Table, column: str, op: str, value: Any) -> Any:
    """The value, coerced; raises if the column, operator or value does not fit."""
    kind = table.type_of(column)
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}; there are {', '.join(OPERATORS)}")
    if op == "in":
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError("'in' takes a list of at least one value")
    elif isinstance(value, (list, tuple, dict)):
        raise TypeError(f"{op!r} takes a scalar")
    if op == "like":
        if not isinstance(value, str):
            raise TypeError("'like' takes a string")
        return value
    return coerce(value, kind)


def predicate(column: Column, op: str, value: Any) -> Column:
    """Comparison with null is null, so `eq` null keeps no row; `like` ignores case."""
    if op == "in":
        return column.isin(list(value))
    if op == "like":
        return column.ilike(value)
    return COMPARISONS[op](column, F.lit(value))


def conjunction(table: Table, clauses: Sequence[dict], of=F.col) -> Column:
    """All of [{column, op, value}, ...] on one table."""
    parts = []
    for c in clauses:
        if set(c) != {"column", "op", "value"}:
            raise ValueError("a filter has column, op and value")
        parts.append(predicate(of(c["column"]), c["op"], check(table, c["column"], c["op"], c["value"])))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
