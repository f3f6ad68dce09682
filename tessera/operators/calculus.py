"""The calculus over foreign-key graphs: nine primitives over lazily built row bags.

A plan lowers to a row bag: all columns of its target table, a row for each way to reach it. Column pruning drops what the
materializer does not use, and no table is joined to itself by its key to get its columns back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import check, predicate
from tessera.plans.catalog import Catalog, Table
from tessera.plans.cursor import Intersect, Order, Plan, Store, Via, Where, split_order

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
LEAST_ROWS, MOST_ROWS = 2, 5


def ordered(column: str | Column, descending: bool) -> Column:
    """PostgreSQL's order of nulls: last ascending, first descending."""
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def aggregated(column: Column, fn: str, kind: str) -> Column:
    """The aggregate of the column as it is; sums of integers as bigint."""
    if fn == "sum" and kind in ("tinyint", "smallint", "int", "bigint"):
        return F.sum(column).cast("bigint")
    return AGGREGATES[fn](column)


class Calculus:
    """frames: gives a table's DataFrame by name."""

    def __init__(self, catalog: Catalog, frames: Callable[[str], DataFrame], capacity: int = 256):
        self.catalog, self.frames, self.store = catalog, frames, Store(capacity)
        self._bags: dict[str, DataFrame] = {}

    def _key(self, table: str) -> tuple[str, ...]:
        key = self.catalog.table(table).key
        if not key:
            raise ValueError(f"{table} has no key")
        return key

    # construction

    def rows_where(self, table: str, column: str, op: str, value: Any) -> str:
        value = check(self.catalog.table(table), column, op, value)
        return self.store.intern(Where(table, column, op, tuple(value) if isinstance(value, list) else value))

    def rows_via(self, cursor: str, edge: str) -> str:
        plan = self.store.plan(cursor)
        return self.store.intern(Via(plan, edge, self.catalog.hop(plan.table, edge).dest))

    def intersect(self, left: str, right: str) -> str:
        a, b = self.store.plan(left), self.store.plan(right)
        if a.table != b.table:
            raise ValueError(f"cannot intersect rows of {a.table} and {b.table}")
        self._key(a.table)
        return self.store.intern(Intersect(a, b, a.table))

    def order_by(self, cursor: str, column: str, direction: str = "asc") -> str:
        plan = self.store.plan(cursor)
        self.catalog.table(plan.table).type_of(column)
        if direction not in ("asc", "desc"):
            raise ValueError("direction is asc or desc")
        return self.store.intern(Order(plan, column, direction == "desc", plan.table))

    # lowering

    def bag(self, plan: Plan) -> DataFrame:
        """Rows of the plan's table with their multiplicity; orders do not count."""
        if isinstance(plan, Order):
            return self.bag(plan.source)
        if isinstance(plan, Where):
            return self.frames(plan.table).where(predicate(F.col(plan.column), plan.op, plan.value))
        if isinstance(plan, Via):
            hop = self.catalog.hop(plan.source.table, plan.edge)
            here = self.bag(plan.source).select(F.col(hop.origin_column).alias("_from"))
            there = self.frames(hop.dest)
            return here.join(there, F.col("_from") == there[hop.dest_column]).drop("_from")
        key = self._key(plan.table)
        both = self.bag(plan.left).select(*key).intersect(self.bag(plan.right).select(*key))
        return self.frames(plan.table).join(both, list(key), "left_semi")

    def _bag(self, cursor: str) -> tuple[DataFrame, Table]:
        plan = self.store.plan(cursor)
        if cursor not in self._bags:
            self._bags[cursor] = self.bag(plan)
        return self._bags[cursor], self.catalog.table(plan.table)

    @staticmethod
    def _few(n: int) -> int:
        if isinstance(n, bool) or not isinstance(n, int) or not LEAST_ROWS <= n <= MOST_ROWS:
            raise ValueError(f"n is {LEAST_ROWS} to {MOST_ROWS}")
        return n

    # materializers

    def take(self, cursor: str, n: int) -> DataFrame:
        """The first n keys. Of bags that can repeat a row, each key counts once, at its best value of every order."""
        self._few(n)
        base, keys = split_order(self.store.plan(cursor))
        key, bag = self._key(base.table), self.bag(base)
        if isinstance(base, Where):
            return bag.orderBy(*(ordered(c, d) for c, d in keys), *(ordered(k, False) for k in key)).select(*key).limit(n)
        if not keys:
            return bag.select(*key).distinct().orderBy(*(ordered(k, False) for k in key)).limit(n)
        best = [(F.max if d else F.min)(c).alias(f"_o{i}") for i, (c, d) in enumerate(keys)]
        out = bag.groupBy(*key).agg(*best)
        return out.orderBy(*(ordered(f"_o{i}", d) for i, (_, d) in enumerate(keys)), *(ordered(k, False) for k in key)).select(*key).limit(n)

    def count(self, cursor: str) -> DataFrame:
        return self._bag(cursor)[0].agg(F.count("*").alias("cnt"))

    def aggregate(self, cursor: str, fn: str, column: str) -> DataFrame:
        """sum, avg, min or max of a column of the target table; null over no rows."""
        if fn not in AGGREGATES:
            raise ValueError(f"unknown aggregate {fn!r}")
        bag, table = self._bag(cursor)
        return bag.agg(aggregated(F.col(column), fn, table.type_of(column)).alias("agg"))

    def group_top(self, cursor: str, group: str, fn: str, n: int, column: str | None = None) -> DataFrame:
        """The n groups of the greatest aggregate over the bag; a null aggregate comes first, ties go to the lesser group."""
        self._few(n)
        bag, table = self._bag(cursor)
        table.type_of(group)
        if fn == "count":
            if column is not None:
                raise ValueError("count takes no column")
            value = F.count("*")
        elif fn in AGGREGATES and column is not None:
            value = aggregated(F.col(column), fn, table.type_of(column))
        else:
            raise ValueError(f"{fn!r} needs a column and is one of count, {', '.join(AGGREGATES)}")
        out = bag.groupBy(F.col(group).alias("group_value")).agg(value.alias("agg_value"))
        return out.orderBy(ordered("agg_value", True), ordered("group_value", False)).limit(n)

    def read(self, table: str, row_id: Any, columns: Sequence[str]) -> DataFrame:
        """Columns of the row of that key; no row if there is none. Composite keys take a sequence."""
        t, key = self.catalog.table(table), self._key(table)
        if not columns:
            raise ValueError("name one column at least")
        for c in columns:
            t.type_of(c)
        ids = list(row_id) if isinstance(row_id, (list, tuple)) else [row_id]
        if len(ids) != len(key):
            raise ValueError(f"the key of {table} has {len(key)} parts")
        out = self.frames(table)
        for k, v in zip(key, ids, strict=True):
            out = out.where(F.col(k) == F.lit(check(t, k, "eq", v)))
        return out.select(*columns).limit(1)

    def read_one(self, table: str, row_id: Any, columns: Sequence[str]) -> dict:
        """As read(), collected; raises LookupError if there is no such row."""
        row = self.read(table, row_id, columns).first()
        if row is None:
            raise LookupError(f"{table} has no row {row_id!r}")
        return row.asDict()
