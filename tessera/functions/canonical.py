"""Answers in canonical form: contracts, canonical JSON, exact-match reward, schema inference."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMITIVES = ("string", "int", "float", "bool", "date", "datetime", "enum")


class Mismatch(ValueError):
    """A value that does not fit its contract."""


@dataclass(frozen=True)
class Field:
    """A contract. kind: one of PRIMITIVES, object or list. ordered, sort_key and unique are for lists."""

    kind: str
    name: str = ""
    nullable: bool = False
    values: tuple = ()
    fields: tuple[Field, ...] = ()
    items: Field | None = None
    ordered: bool = False
    sort_key: tuple[str, ...] = ()
    unique: bool = False
    _: Any = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.kind not in (*PRIMITIVES, "object", "list"):
            raise ValueError(f"unknown kind {self.kind!r}")
        if (self.kind == "enum") != bool(self.values):
            raise ValueError("an enum, and nothing else, has values")
        if (self.kind == "object") != bool(self.fields):
            raise ValueError("an object, and nothing else, has fields")
        if (self.kind == "list") != (self.items is not None):
            raise ValueError("a list, and nothing else, has items")
        names = [f.name for f in self.fields]
        if len({*names}) < len(names) or "" in names:
            raise ValueError("fields need different names")
        if self.kind != "list" and (self.ordered or self.sort_key or self.unique):
            raise ValueError("only lists are ordered, sorted or unique")
        if self.kind == "list":
            if self.ordered and (self.sort_key or self.unique):
                raise ValueError("an ordered list has no sort_key and is not unique")
            if self.items.kind == "object" and not self.ordered and not self.sort_key:
                raise ValueError("an unordered list of objects needs a sort_key")
            own = {f.name: f for f in self.items.fields}
            for k in self.sort_key:
                if k not in own or own[k].kind not in PRIMITIVES or own[k].nullable:
                    raise ValueError(f"sort_key {k!r} is not a primitive non-null field of the items")


def dumps(value: Any) -> str:
    """JSON with sorted keys, no spaces, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _date(value: Any) -> str:
    if not isinstance(value, str):
        raise Mismatch("a date is text")
    text = re.sub(r"[zZ]$", "+00:00", value.strip())
    try:
        return date.fromisoformat(text).isoformat()
    except ValueError:
        pass
    try:  # a datetime means its date
        return datetime.fromisoformat(text).date().isoformat()
    except ValueError as e:
        raise Mismatch(str(e)) from e


def _datetime(value: Any) -> str:
    if not isinstance(value, str):
        raise Mismatch("a datetime is text")
    try:
        return datetime.fromisoformat(re.sub(r"[zZ]$", "+00:00", value.strip())).isoformat(timespec="seconds")
    except ValueError as e:
        raise Mismatch(str(e)) from e


def canonicalize(value: Any, contract: Field) -> Any:
    """The value in canonical form, or Mismatch."""
    if value is None:
        if contract.nullable:
            return None
        raise Mismatch(f"{contract.name or contract.kind} is null")
    kind = contract.kind
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "string":
        if isinstance(value, str):
            return value
    elif kind == "int":
        if number and isinstance(value, int):
            return value
    elif kind == "float":
        if number and abs(value) < float("inf"):
            return float(value)
    elif kind == "bool":
        if isinstance(value, bool):
            return value
    elif kind == "date":
        return _date(value)
    elif kind == "datetime":
        return _datetime(value)
    elif kind == "enum":
        if any(value == v and type(value) is type(v) for v in contract.values):
            return value
    elif kind == "object":
        if isinstance(value, dict):
            known = {f.name for f in contract.fields}
            if extra := set(value) - known:
                raise Mismatch(f"unknown fields: {', '.join(sorted(map(str, extra)))}")
            out = {}
            for f in contract.fields:
                if f.name not in value and not f.nullable:
                    raise Mismatch(f"{f.name} is missing")
                out[f.name] = canonicalize(value.get(f.name), f)
            return out
    elif isinstance(value, list):
        items = [canonicalize(v, contract.items) for v in value]
        if contract.unique:
            items = list({dumps(v): v for v in reversed(items)}.values())[::-1]
        if contract.ordered:
            return items
        if contract.sort_key:
            return sorted(items, key=lambda v: ([_rank(v[k]) for k in contract.sort_key], dumps(v)))
        return sorted(items, key=_rank)
    raise Mismatch(f"{value!r} is not a {kind}")


def _rank(value: Any) -> tuple:
    """An order of values of one kind: nulls first, numbers by size, text by code points, nested values by their JSON."""
    if value is None:
        return (0, 0, "")
    if isinstance(value, (int, float)):
        return (1, value, "")
    return (2, 0, value if isinstance(value, str) else dumps(value))


def reward(submitted: str | None, expected: Any, contract: Field) -> tuple[float, str]:
    """1 and 'matched' if the submitted JSON is, in canonical form, the expected value; or else 0 and why not."""
    try:
        value = json.loads(submitted) if submitted is not None else None
        if submitted is None:
            raise ValueError
    except ValueError:
        return 0.0, "decode_failed"
    try:
        got = canonicalize(value, contract)
    except Mismatch:
        return 0.0, "schema_mismatch"
    return (1.0, "matched") if dumps(got) == dumps(canonicalize(expected, contract)) else (0.0, "em_mismatch")


def canonical_list(column: Column, unique: bool = False) -> Column:
    """An array of scalars or structs in canonical order, in the JVM; for shapes that are known."""
    return F.array_sort(F.array_distinct(column) if unique else column)


def infer(value: Any, name: str = "") -> Field:
    """A contract that the value fits. A list is judged by its first item; null is a nullable string; lists of objects are sorted by all their primitive non-null fields."""
    if value is None:
        return Field("string", name, nullable=True)
    if isinstance(value, bool):
        return Field("bool", name)
    if isinstance(value, (int, float)):
        return Field("int" if isinstance(value, int) else "float", name)
    if isinstance(value, dict):
        return Field("object", name, fields=tuple(infer(v, k) for k, v in value.items()))
    if isinstance(value, list):
        item = infer(value[0]) if value else Field("string")
        keys = tuple(f.name for f in item.fields if f.kind in PRIMITIVES and not f.nullable)
        return Field("list", name, items=item, sort_key=keys, ordered=item.kind == "object" and not keys)
    for kind, read, shape in (("datetime", _datetime, r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), ("date", _date, r"\d{4}-\d\d-\d\d$")):
        if isinstance(value, str) and re.match(shape, value):
            try:
                read(value)
                return Field(kind, name)
            except Mismatch:
                pass
    return Field("string", name)


def flatten(contract: Field, prefix: str = "") -> list[str]:
    """Paths of the primitive parts: a.b[]:type."""
    here = f"{prefix}.{contract.name}" if prefix and contract.name else prefix or contract.name
    if contract.kind == "object":
        return [p for f in contract.fields for p in flatten(f, here)]
    if contract.kind == "list":
        return flatten(contract.items, here + "[]")
    return [f"{here}:{contract.kind}"]


def words(text: Column) -> Column:
    """Runs of underscores, dashes and white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[_\-\s]+", " "))


def slots(value: Any) -> list[str]:
    """Names that an answer fills: an object's keys, or those of all objects in a list."""
    if isinstance(value, dict):
        return sorted(value)
    if isinstance(value, list):
        return sorted({k for v in value if isinstance(v, dict) for k in v})
    return []


def slot_change(before: Any, after: Any) -> dict:
    a, b = set(slots(before)), set(slots(after))
    return {"added": sorted(b - a), "removed": sorted(a - b), "delta": len(b) - len(a), "changed": dumps(before) != dumps(after)}


def leaves(value: Any) -> list[str]:
    """Trimmed lower-case text leaves."""
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    return [value.strip().lower()] if isinstance(value, str) and value.strip() else []
