"""The leaves of JSON of any shape, in the JVM.

JSON's tokens are a regular language: once escapes are out of the way, one pattern walks over a text and tells keys from
values, however deep they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that JSON cannot hold as they are; they stand for an escaped backslash and an escaped quote while text is cut.
_BACKSLASH, _QUOTE = "\x01", "\x02"
#: A string, which is a key if a colon follows, or another scalar.
_TOKEN = r'"[^"]*"(?:\s*:)?|-?[0-9][0-9.eE+-]*|\btrue\b|\bfalse\b|\bnull\b'


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def _tokens(text: Column) -> Column:
    masked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    found = F.filter(F.regexp_extract_all(masked, F.lit(_TOKEN), F.lit(0)), lambda t: ~F.endswith(t, F.lit(":")))
    return F.when(is_json(text), found).otherwise(F.array().cast("array<string>"))


def _value(token: Column) -> Column:
    """The text of a string token."""
    plain = F.replace(F.replace(token, F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))
    escaped = F.contains(token, F.lit("\\")) | F.contains(token, F.lit(_BACKSLASH)) | F.contains(token, F.lit(_QUOTE))
    # without escapes it is what stands between the quotes
    return F.when(escaped, F.element_at(F.from_json(F.concat(F.lit("["), plain, F.lit("]")), "array<string>"), 1)).otherwise(F.substring(token, F.lit(2), F.length(token) - F.lit(2)))


def folded(text: Column) -> Column:
    """Lower case, without white space around."""
    return F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")


def string_leaves(text: Column) -> Column:
    """Trimmed lower-case string values at any depth, none of them empty; nothing for text that is no JSON."""
    strings = F.transform(F.filter(_tokens(text), lambda t: F.startswith(t, F.lit('"'))), lambda t: folded(_value(t)))
    return F.filter(strings, lambda s: s != "")


def has_blank(text: Column) -> Column:
    """Whether a string value at any depth is empty or white space."""
    return F.exists(_tokens(text), lambda t: F.startswith(t, F.lit('"')) & (folded(_value(t)) == ""))


def number_name(text: Column) -> Column:
    """One name for equal numbers, whatever their spelling; true is 1 and false is 0."""
    whole = text.rlike(r"^-?[0-9]{1,18}$")
    double = text.try_cast("double")
    integral = (double == F.floor(double)) & (F.abs(double) < 1e15)
    return F.concat(F.lit("n:"), F.when(text == "true", "1").when(text == "false", "0").when(whole, text.try_cast("bigint").cast("string")).when(integral, double.try_cast("bigint").cast("string")).otherwise(double.cast("string")))


def scalar_leaves(text: Column, nulls: bool = False) -> Column:
    """A name for each scalar value at any depth; equal values have equal names, text whatever its case and the white space around it."""
    kept = _tokens(text) if nulls else F.filter(_tokens(text), lambda t: t != "null")
    return F.transform(kept, lambda t: F.when(F.startswith(t, F.lit('"')), F.concat(F.lit("s:"), folded(_value(t)))).when(t == "null", "null").otherwise(number_name(t)))


def flat_object(text: Column) -> Column:
    """An object's own scalar values, without those inside of nested ones, as scalar_leaves() names them."""
    # a nested value is JSON again, and starts with its bracket
    parts = F.coalesce(F.from_json(text, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    shown = F.transform(F.map_values(parts), lambda v: F.coalesce(F.to_json(F.struct(v.alias("v"))), F.lit("{}")))
    # {"v":...}
    return F.flatten(F.transform(F.filter(shown, lambda s: ~s.rlike(r'^\{"v":[\[{]')), lambda s: scalar_leaves(s, True)))


def ungrounded(answers: DataFrame, observed: DataFrame, answer: str = "answer", seen: str = "observed", key: str = "task_id") -> DataFrame:
    """(key, value): text leaves of answers, as JSON, that no observation of the same task has."""
    a = answers.select(key, F.explode(string_leaves(F.col(answer))).alias("value")).distinct()
    b = observed.select(key, F.explode(string_leaves(F.col(seen))).alias("value")).distinct()
    return a.join(b, [key, "value"], "left_anti")
