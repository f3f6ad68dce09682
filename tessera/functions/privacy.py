"""Column visibility by name, and redaction as a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISIBLE, INTERNAL, BLOCKED = "user_visible", "internal", "blocked"
# Parts of names of columns that are never shown, of those that only the engine sees, of columns that are
# safe in a table about people, and of such tables.
BLOCKED_NAMES = "ssn social_security passport tax_id cvv pin password secret token api_key private_key credit_card card_number bank_account iban routing_number".split()
INTERNAL_NAMES = "email e_mail phone mobile telephone fax address street zipcode postal_code postcode city state province country birth birthdate birthday dob first_name last_name full_name".split()
SAFE_NAMES = "name title label status type kind category language code rating mode method channel plan tier level".split()
SENSITIVE_TABLES = "customer user member account profile person staff employee contact address patient student teacher".split()


def has_part(name: str, parts: Sequence[str]) -> bool:
    """Whether one of the parts stands in the name between underscores or its ends."""
    return any(f"_{p}_" in f"_{name.strip().lower()}_" for p in parts)


def visibility(table: str, column: str, overrides: Mapping[str, str] | None = None, sensitive_tables: Sequence[str] | None = None, safe_columns: Sequence[str] | None = None, schema: str = "public", default: str = VISIBLE) -> str:
    """An override by schema.table.column, table.column or column comes first; then blocked and internal names; then the default. Where that is blocked, safe names are internal, but not in tables about people. Tables and safe columns may be named outright."""
    overrides = overrides or {}
    for key in (f"{schema}.{table}.{column}", f"{table}.{column}", column):
        if key in overrides:
            return overrides[key]
    for parts, label in ((BLOCKED_NAMES, BLOCKED), (INTERNAL_NAMES, INTERNAL)):
        if has_part(column, parts):
            return label
    sensitive = has_part(table, SENSITIVE_TABLES) if sensitive_tables is None else table in sensitive_tables
    safe = has_part(column, SAFE_NAMES) if safe_columns is None else column in safe_columns
    return INTERNAL if default == BLOCKED and safe and not sensitive else default


def labelled(df: DataFrame, table: str, defaults: Sequence[str], overrides: Mapping[str, str] | None = None) -> DataFrame:
    """table_name, column_name, default_label, label and shown (its values that are not null) of every column, for each default."""
    labels = [(d, visibility(table, c, overrides, default=d)) for c in df.columns for d in defaults]
    one = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(df.columns[i // len(defaults)]).alias("column_name"), F.lit(d).alias("default_label"), F.lit(label).alias("label"), F.col(f"_{i // len(defaults)}").alias("shown")) for i, (d, label) in enumerate(labels)))
    return one.select(F.lit(table).alias("table_name"), F.explode(rows).alias("r")).select("table_name", "r.*")


def redact(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Values of internal columns become [INTERNAL], others' [REDACTED]; nulls and visible columns pass; a column without a label is blocked."""
    out = []
    for c in df.columns:
        label = labels.get(c, BLOCKED)
        mark = {INTERNAL: "[INTERNAL]"}.get(label, "[REDACTED]")
        out.append(F.col(c) if label == VISIBLE else F.when(F.col(c).isNotNull(), F.lit(mark)).alias(c))
    return df.select(*out)
