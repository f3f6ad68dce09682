"""Contracts compiled to Catalyst expressions: JSON of a known or open shape is checked and brought into canonical form in the JVM.

A compiled contract is a function from a variant to text: the value's canonical JSON, or null where it does not fit. Null
passes through concat(), so that one part that does not fit takes the whole with it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import Field, dumps
from tessera.sources.scratch import written

_DATE = r"^(\d{4})-?(\d\d)-?(\d\d)$"
#: Date, one character, time to the minute, second or its parts, and an offset, with or without colons.
_MOMENT = r"^(\d{4}-\d\d-\d\d|\d{8})[^0-9](\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,]\d{1,6}\d*)?)?)?(?:([+-])(\d\d):?(\d\d)(?::?\d\d(?:\.\d+)?)?)?$"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, OBJECT, ARRAY, or DOUBLE for all other numbers."""
    name = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    return F.when(name.isin("DECIMAL", "FLOAT"), "DOUBLE").otherwise(name)


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def quoted(text: Column) -> Column:
    """Text as a JSON string."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""))


def _day(text: Column) -> Column:
    """YYYY-MM-DD of YYYY-MM-DD or YYYYMMDD, or null where there is no such day."""
    plain = F.regexp_replace(text, _DATE, "$1-$2-$3")
    return F.when(text.rlike(_DATE) & ~text.rlike(r"^(\d{4}-\d{4}|\d{6}-\d\d)$"), F.date_format(F.try_to_date(plain, "yyyy-MM-dd"), "yyyy-MM-dd"))


def _stripped(v: Column) -> Column:
    """Text without white space around it, a Z at its end as an offset."""
    return F.regexp_replace(F.regexp_replace(_get(v, "string"), r"^\s+|\s+$", ""), r"[zZ]$", "+00:00")


def _moment_parts(text: Column) -> Column:
    """day and time (with its offset) of a datetime, or null."""
    part = lambda k: F.regexp_extract(text, _MOMENT, k)
    two = lambda k: F.when(part(k) == "", "00").otherwise(part(k))
    below = lambda k, n: two(k).try_cast("int") < n
    offset = F.when(part(5) == "", "").otherwise(F.concat(part(5), part(6), F.lit(":"), part(7)))
    fits = text.rlike(_MOMENT) & below(2, 24) & below(3, 60) & below(4, 60) & below(6, 24) & below(7, 60)
    offset = F.when(offset == "-00:00", "+00:00").otherwise(offset)
    return F.when(fits, F.struct(_day(part(1)).alias("day"), F.concat(two(2), F.lit(":"), two(3), F.lit(":"), two(4), offset).alias("time")))


def _whole_day(text: Column) -> Column:
    return F.coalesce(_day(text), _moment_parts(text)["day"])


def _moment(text: Column) -> Column:
    # a day alone is its first second
    full = let(_moment_parts(text), lambda m: F.concat(m["day"], F.lit("T"), m["time"]))
    return F.coalesce(F.concat(_day(text), F.lit("T00:00:00")), full)


def _scalar(v: Column, contract: Field) -> Column:
    kind = contract.kind
    if kind == "string":
        return F.when(kind_of(v) == "STRING", quoted(_get(v, "string")))
    if kind == "int":
        return F.when(kind_of(v) == "BIGINT", _get(v, "bigint").cast("string"))
    if kind == "float":
        return F.when(kind_of(v).isin("BIGINT", "DOUBLE"), _get(v, "double").cast("string"))
    if kind == "bool":
        return F.when(kind_of(v) == "BOOLEAN", _get(v, "boolean").cast("string"))
    if kind in ("date", "datetime"):
        return F.when(kind_of(v) == "STRING", quoted(let(_stripped(v), _whole_day if kind == "date" else _moment)))
    # an enum: the same kind and the same value
    names = {str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE"}
    shown = {str: lambda: quoted(_get(v, "string")), bool: lambda: _get(v, "boolean").cast("string"), int: lambda: _get(v, "bigint").cast("string"), float: lambda: _get(v, "double").cast("string")}
    out = F.lit(None).cast("string")
    for t in names:
        same = [x for x in contract.values if type(x) is t]
        if same:
            texts = [json.dumps(x, ensure_ascii=False) if t in (str, bool, int) else None for x in same]
            fits = shown[t]().isin(*texts) if t is not float else _get(v, "double").isin(*same)
            out = F.when((kind_of(v) == names[t]) & fits, shown[t]()).otherwise(out)
    return out


def _path(name: str) -> str:
    # a variant's path has no escapes: the quote that the name does not hold stands around it
    quote = "'" if '"' in name else '"'
    return f"$[{quote}{name}{quote}]"


def _object(v: Column, contract: Field) -> Column:
    names = [f.name for f in contract.fields]
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    parts = []
    for k, f in enumerate(sorted(contract.fields, key=lambda f: f.name)):
        value = compiled(F.try_variant_get(v, _path(f.name), "variant"), f)
        parts += [F.lit(("," if k else "") + dumps(f.name) + ":"), value]
    fits = (kind_of(v) == "OBJECT") & (F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0)
    return F.when(fits, F.concat(F.lit("{"), *parts, F.lit("}")))


_ORDERS = {"int": "bigint", "float": "double", "bool": "boolean"}


def _key(v: Column, f: Field) -> Column:
    """A sort key's value, as its kind is ordered."""
    value = F.try_variant_get(v, _path(f.name), "variant")
    return F.try_variant_get(v, _path(f.name), _ORDERS[f.kind]) if f.kind in _ORDERS else compiled(value, f)


def _list(v: Column, contract: Field) -> Column:
    items = F.try_variant_get(v, "$", "array<variant>")
    own = {f.name: f for f in contract.items.fields}

    def one(x: Column) -> Column:
        keys = [_key(x, own[k]).alias(f"k{i}") for i, k in enumerate(contract.sort_key)]
        return F.struct(*keys, compiled(x, contract.items).alias("text"))

    def joined(parts: Column) -> Column:
        done = parts if contract.ordered else F.array_sort(parts)
        texts = F.transform(done, lambda p: p["text"])
        texts = F.array_distinct(texts) if contract.unique else texts
        return F.when(~F.exists(parts, lambda p: p["text"].isNull()), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))

    return F.when(kind_of(v) == "ARRAY", let(F.transform(items, one), joined))


def compiled(v: Column, contract: Field) -> Column:
    """Canonical JSON of a variant under a contract, or null where it does not fit."""

    def body(x: Column) -> Column:
        make = {"object": _object, "list": _list}.get(contract.kind, _scalar)
        empty = x.isNull() | F.is_variant_null(x)
        return F.when(empty, F.lit("null" if contract.nullable else None)).otherwise(make(x, contract))

    return let(v, body)


def canonical_json(text: Column, contract: Field) -> Column:
    """Canonical JSON of JSON text, or null where it is none or does not fit.

    Lists that are not ordered are sorted by their sort_key, else by their items' JSON. Whole numbers beyond 64 bits are no
    ints; an object that repeats a key is no JSON.
    """
    return let(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), compiled(v, contract)))


def reward(submitted: Column, expected: Column, contract: Field) -> Column:
    """Struct of reward and status: 1 and 'matched' if both are the same in canonical form, or else 0 and decode_failed, schema_mismatch (of either) or em_mismatch."""

    def judged(pair: Column) -> Column:
        status = F.when(~pair["read"], "decode_failed").when(pair["a"].isNull() | pair["b"].isNull(), "schema_mismatch").when(pair["a"] == pair["b"], "matched").otherwise("em_mismatch")
        return let(status, lambda s: F.struct(F.when(s == "matched", 1.0).otherwise(0.0).alias("reward"), s.alias("status")))

    read = F.coalesce(F.try_parse_json(submitted).isNotNull(), F.lit(False))
    return let(F.struct(read.alias("read"), canonical_json(submitted, contract).alias("a"), canonical_json(expected, contract).alias("b")), judged)


def rewards(df: DataFrame, submitted: str, expected: str, contract: Field) -> DataFrame:
    """Adds reward and status for columns of submitted and expected JSON."""
    return df.withColumn("_r", reward(F.col(submitted), F.col(expected), contract)).select("*", "_r.reward", "_r.status").drop("_r")


def open_form(text: Column) -> Column:
    """Objects and lists that parse with their keys sorted and no spaces; other text as it is. Numbers of one value have one form."""
    shown = F.to_json(F.try_parse_json(text))
    return F.when(F.ltrim(text).rlike(r"^[\[{]"), F.coalesce(shown, text)).otherwise(text)


def inferred_paths(df: DataFrame, answer: str) -> DataFrame:
    """(path, n): the paths of the contracts that all rows' answers, as JSON, fit, and how many rows have each. An answer that does not parse has none.

    A list is judged by its first item, an empty one holds text; null is text. Each round opens one level of all answers,
    so that there are as many as the deepest has levels.
    """
    level = df.groupBy(F.col(answer).alias("text")).agg(F.count("*").alias("n")).select(F.lit("").alias("path"), F.to_json(F.try_parse_json("text")).alias("text"), kind_of(F.try_parse_json("text")).alias("kind"), "n")
    level, leaves = written(level.where("text is not null"), "paths"), []
    while True:
        scalar = ~F.col("kind").isin("OBJECT", "ARRAY")
        here = let(F.try_parse_json("text"), lambda v: _get(v, "string"))
        name = F.when(F.col("kind") == "STRING", let(here, _text_kind)).when(F.col("kind") == "BIGINT", "int").when(F.col("kind") == "DOUBLE", "float").when(F.col("kind") == "BOOLEAN", "bool").otherwise("string")
        leaves.append(level.where(scalar).groupBy(F.concat("path", F.lit(":"), name).alias("path")).agg(F.sum("n").alias("n")))
        deeper = level.where(~scalar)
        if deeper.isEmpty():
            break
        v = F.try_parse_json("text")
        fields = deeper.where("kind = 'OBJECT'").select("path", "n", F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("key", "v"))
        fields = fields.select(F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), "v", "n")
        items = deeper.where("kind = 'ARRAY'").select(F.concat("path", F.lit("[]")).alias("path"), F.try_variant_get(v, "$[0]", "variant").alias("v"), "n")
        next_level = fields.union(items).select("path", F.coalesce(F.to_json("v"), F.lit('""')).alias("text"), F.coalesce(kind_of(F.col("v")), F.lit("VOID")).alias("kind"), "n")
        level = written(next_level.groupBy("path", "text", "kind").agg(F.sum("n").alias("n")), "paths")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out.groupBy("path").agg(F.sum("n").alias("n"))


def _text_kind(text: Column) -> Column:
    """datetime, date or string, by its shape and whether it can be read."""
    plain = F.regexp_replace(text, r"[zZ]$", "+00:00")
    moment = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d") & _moment(plain).isNotNull()
    return F.when(moment, "datetime").when(text.rlike(r"^\d{4}-\d\d-\d\d$") & _day(text).isNotNull(), "date").otherwise("string")
