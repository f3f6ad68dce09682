"""Values of requests, brought to the type of their column before a plan is built."""

from __future__ import annotations

from datetime import date, datetime, time
from decimal import Decimal, InvalidOperation
from typing import Any

INTEGERS = ("tinyint", "smallint", "int", "bigint")
FLOATS = ("float", "double")
TRUE, FALSE = ("t", "true", "y", "yes", "on", "1"), ("f", "false", "n", "no", "off", "0")


def is_numeric(kind: str) -> bool:
    return kind in INTEGERS or kind in FLOATS or kind.startswith("decimal")


def is_ordered(kind: str) -> bool:
    """Whether least and greatest values are shown: all but Boolean, binary and nested types."""
    return is_numeric(kind) or kind in ("string", "date", "timestamp", "timestamp_ntz")


def coerce(value: Any, kind: str) -> Any:
    """The value as the column's type. Strings are read; lists go element by element; other values stay."""
    if isinstance(value, (list, tuple)):
        return [coerce(v, kind) for v in value]
    if isinstance(value, dict):
        raise TypeError("a value must be a scalar or a list of scalars")
    if not isinstance(value, str):
        return value
    text = value.strip()
    try:
        if kind in INTEGERS:
            return int(text)
        if kind in FLOATS:
            return float(text)
        if kind.startswith("decimal"):
            return Decimal(text)
        if kind == "boolean":
            if text.lower() in TRUE:
                return True
            if text.lower() in FALSE:
                return False
            raise ValueError(text)
        if kind in ("timestamp", "timestamp_ntz"):
            return datetime.fromisoformat(text)
        if kind == "date":
            return date.fromisoformat(text)
        if kind == "time":
            return time.fromisoformat(text)
    except (ValueError, InvalidOperation) as e:
        raise ValueError(f"{value!r} is not a {kind}") from e
    return value
