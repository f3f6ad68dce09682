"""Looking around a graph of tables: maps, hubs, samples, profiles, neighbourhoods, paths, key checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from hashlib import md5
from math import log
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import check, conjunction
from tessera.functions.values import is_numeric, is_ordered
from tessera.operators.calculus import ordered
from tessera.plans.catalog import Catalog

Frames = Callable[[str], DataFrame]


def edges_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(e.source, e.column, e.target, e.target_column, e.forward) for e in catalog.edges]
    return spark.createDataFrame(rows, "source string, column string, target string, target_column string, label string")


def schema_map(catalog: Catalog, root: str | None = None, depth: int = 2) -> dict:
    """Tables within depth of the root, the edges among them by label, hubs and bridges of the whole graph."""
    names = catalog.nearby(root, depth)
    inside = [e for e in catalog.edges if e.source in names and e.target in names]
    return {"root": root, "depth": depth, "tables": [{"name": n, "columns": [{"name": c, "type": t} for c, t in catalog.table(n).columns], "key": list(catalog.table(n).key)} for n in names], "edges": [{"forward": e.forward, "reverse": e.reverse} for e in inside], "hubs": hub_names(catalog), "bridges": sorted({e.source for e in catalog.edges if sum(x.source == e.source for x in catalog.edges) >= 2})}


def hub_names(catalog: Catalog) -> list[str]:
    degree = {t.name: sum((e.source == t.name) + (e.target == t.name) for e in catalog.edges) for t in catalog.tables}
    best = sorted((t for t in degree if degree[t]), key=lambda t: (-degree[t], t))
    return best[: max(1, len(degree) // 3)]


def schema_map_frame(spark: SparkSession, catalog: Catalog, root: str | None = None, depth: int = 2) -> DataFrame:
    names = catalog.nearby(root, depth)
    rows = [(e.forward, e.reverse, e.source, e.target) for e in catalog.edges if e.source in names and e.target in names]
    return spark.createDataFrame(rows, "forward string, reverse string, source string, target string")


def hubs(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The third of tables (one at least) of the highest degree, in and out."""
    e = edges_frame(spark, catalog)
    degree = e.select(F.col("source").alias("table_name")).union(e.select("target")).groupBy("table_name").agg(F.count("*").alias("degree"))
    return degree.orderBy(F.desc("degree"), "table_name").limit(max(1, len(catalog.tables) // 3))


def bridges(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """Tables that hold two foreign keys or more."""
    return edges_frame(spark, catalog).groupBy(F.col("source").alias("table_name")).agg(F.count("*").alias("fk_count")).where("fk_count >= 2")


def summary(catalog: Catalog, fanout: dict[str, float] | None = None, most: int = 50) -> dict:
    """The short form: hubs are tables with 3 inbound edges or more; bridges have two foreign keys and nothing else to read."""
    inbound = {t.name: sum(e.target == t.name for e in catalog.edges) for t in catalog.tables}
    out = []
    for t in catalog.tables[:most]:
        keys = {e.column for e in catalog.edges if e.source == t.name}
        hidden = dict(t.visibility)
        readable = [c for c in t.names if c not in keys and c not in t.key and hidden.get(c, "user_visible") == "user_visible"]
        steep = {e.forward: round(fanout[e.forward], 2) for e in catalog.edges if e.target == t.name and fanout and fanout.get(e.forward, 0) > 1.5}
        out.append({"table": t.name, "hub": inbound[t.name] >= 3, "bridge": not readable and len(keys) >= 2, "readable": readable, "fanout_in": steep})
    return {"tables": out, "truncated": len(catalog.tables) > most}


def table_sizes(catalog: Catalog, frames: Frames) -> DataFrame:
    """table_name and row_count of every table."""
    return reduce(DataFrame.unionByName, (frames(t.name).agg(F.count("*").alias("row_count")).select(F.lit(t.name).alias("table_name"), "row_count") for t in catalog.tables))


def columns_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """A row for each column: its type, place, and whether it is of the key or a foreign key."""
    rows = [(t.name, c, k, i + 1, c in t.key, any(e.source == t.name and e.column == c for e in catalog.edges)) for t in catalog.tables for i, (c, k) in enumerate(t.columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, ordinal int, is_key boolean, is_foreign_key boolean")


def distinct_counts(frames: Frames, table: str, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    one = frames(table).agg(*(count(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for c in columns))).alias("x")).select("x.*")


def fanout(catalog: Catalog, frames: Frames) -> DataFrame:
    """For each edge: rows of its source for each row of its target; null if that is empty. Each table is counted once."""
    sizes = table_sizes(catalog, frames)
    # one row, of as many entries as tables
    known = sizes.agg(F.map_from_entries(F.collect_list(F.struct("table_name", "row_count"))).alias("n"))
    edges = F.explode(F.array(*(F.struct(F.lit(e.forward).alias("label"), F.col("n")[e.source].alias("source_rows"), F.col("n")[e.target].alias("target_rows")) for e in catalog.edges))).alias("e")
    return known.select(edges).select("e.*", F.when(F.col("e.target_rows") > 0, F.col("e.source_rows") / F.col("e.target_rows")).alias("fanout"))


def fk_orphans(catalog: Catalog, frames: Frames) -> DataFrame:
    """For each edge: rows whose foreign key is set and refers to nothing. The keys' side is as large as its table, so small ones are broadcast and nothing else moves."""
    parts = []
    for e in catalog.edges:
        held = frames(e.source).where(F.col(e.column).isNotNull()).select(F.col(e.column).alias("fk"))
        parts.append(held.join(frames(e.target).select(F.col(e.target_column).alias("pk")), F.col("fk") == F.col("pk"), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(e.forward).alias("label"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def key_duplicates(catalog: Catalog, frames: Frames) -> DataFrame:
    """For each table with a key: keys that more than one row has."""
    parts = []
    for t in catalog.tables:
        if t.key:
            parts.append(frames(t.name).groupBy(*t.key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicates")).select(F.lit(t.name).alias("table_name"), "duplicates"))
    return reduce(DataFrame.unionByName, parts)


def sample(catalog: Catalog, frames: Frames, table: str, n: int, seed: int | None = None, clauses: Sequence[dict] = ()) -> DataFrame:
    """n rows: the first by key, or with a seed those of the least md5 of key and seed."""
    t = catalog.table(table)
    if len(t.key) != 1:
        raise ValueError(f"{table} needs a key of one column")
    df = frames(table).where(conjunction(t, clauses)) if clauses else frames(table)
    if seed is None:
        return df.orderBy(ordered(t.key[0], False)).limit(n)
    return df.orderBy(F.md5(F.concat(F.col(t.key[0]).cast("string"), F.lit(str(seed)))), t.key[0]).limit(n)


def random_anchor(catalog: Catalog, frames: Frames, sizes: dict[str, int], seed: int, least_rows: int = 100) -> tuple[str, DataFrame]:
    """A table, drawn by in-degree among those with a one-column key and rows enough, and one row's key of it."""
    fit = [t for t in catalog.tables if len(t.key) == 1 and sizes.get(t.name, 0) >= least_rows]
    if not fit:
        raise LookupError("no table has rows enough")

    def draw(t) -> float:  # the least of exponential times, at a rate of the table's weight
        u = (int(md5(f"{t.name}{seed}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -log(u) / max(1, sum(e.target == t.name for e in catalog.edges))

    t = min(fit, key=lambda t: (draw(t), t.name))
    return t.name, frames(t.name).select(t.key[0]).orderBy(F.md5(F.concat(F.col(t.key[0]).cast("string"), F.lit(str(seed)))), t.key[0]).limit(1)


def profile_table(catalog: Catalog, frames: Frames, table: str, clauses: Sequence[dict] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """row_count, and distinct and null counts of each column; zeros over no rows. Each column is read by itself and its values are counted before the shuffle, which several exact distinct counts in one aggregate would not do."""
    t = catalog.table(table)
    df = frames(table).where(conjunction(t, clauses)) if clauses else frames(table)
    parts = []
    for c in columns or t.names:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        sums = (F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("v").alias("distinct_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"))
        parts.append(values.agg(*sums).select(F.lit(c).alias("column_name"), "row_count", "distinct_count", "null_count"))
    return reduce(DataFrame.unionByName, parts)


def profile_column(catalog: Catalog, frames: Frames, table: str, column: str, clauses: Sequence[dict] = ()) -> DataFrame:
    """Counts of one column with its least and greatest value, as text; those are null for types without an order."""
    t = catalog.table(table)
    kind = t.type_of(column)
    df = frames(table).where(conjunction(t, clauses)) if clauses else frames(table)
    ends = [F.min(column).cast("string").alias("min_value"), F.max(column).cast("string").alias("max_value")] if is_ordered(kind) else [F.lit(None).cast("string").alias("min_value"), F.lit(None).cast("string").alias("max_value")]
    return df.agg(F.count("*").alias("row_count"), F.count_distinct(column).alias("distinct_count"), F.count_if(F.col(column).isNull()).alias("null_count"), *ends)


def top_values(catalog: Catalog, frames: Frames, table: str, column: str, k: int = 5, clauses: Sequence[dict] = ()) -> DataFrame:
    """The k commonest values, nulls left out, ties to the lesser."""
    t = catalog.table(table)
    t.type_of(column)
    df = frames(table).where(conjunction(t, clauses)) if clauses else frames(table)
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "value").limit(k)


def neighborhood(catalog: Catalog, frames: Frames, table: str, row_id: Any, most: int = 5) -> DataFrame:
    """For each edge at the row: how many rows it leads to, and the first keys as text. A forward edge onto a key leads to one row unless the foreign key is null; tables without a one-column key are 'unsupported'. No rows if the row is not there."""
    t = catalog.table(table)
    if len(t.key) != 1:
        raise ValueError(f"{table} needs a key of one column")
    anchor = frames(table).where(F.col(t.key[0]) == F.lit(check(t, t.key[0], "eq", row_id))).limit(1)
    parts = []
    for h in catalog.hops(table):
        key = catalog.table(h.dest).key
        label = F.lit(h.label).alias("label")
        if len(key) != 1:
            parts.append(anchor.select(label, F.lit("unsupported").alias("status"), F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("string").alias("ids")))
        elif h.is_forward and key[0] == h.dest_column:
            fk = F.col(h.origin_column)
            parts.append(anchor.select(label, F.lit("ok").alias("status"), F.when(fk.isNull(), 0).otherwise(1).cast("bigint").alias("total"), F.coalesce(fk.cast("string"), F.lit("")).alias("ids")))
        else:
            from_here = anchor.select(F.col(h.origin_column).alias("_v"))
            found = frames(h.dest).select(F.col(key[0]).alias("_k"), F.col(h.dest_column).alias("_f")).join(F.broadcast(from_here), F.col("_f") == F.col("_v"))
            first = found.orderBy("_k").limit(most).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_k")), lambda x: x.cast("string")), ",").alias("ids"))  # `most` keys
            total = found.agg(F.count("*").alias("total"))
            # one row each, and none for a row that is not there
            parts.append(total.crossJoin(first).crossJoin(from_here.select("_v")).select(label, F.lit("ok").alias("status"), "total", "ids"))
    if not parts:
        raise ValueError(f"no edge touches {table}")
    return reduce(DataFrame.unionByName, parts)


def path_features(spark: SparkSession, catalog: Catalog, sizes: dict[str, int], max_hops: int = 3) -> DataFrame:
    """Every path of forward edges with the figures that make it hard: hops, fanouts (1 where a size is unknown), rows of its end, whether a hop is unique or can be null, and other paths between its ends."""
    paths = catalog.paths(max_hops)
    ends: dict[tuple[str, str], int] = {}
    for p in paths:
        ends[p[0].source, p[-1].target] = ends.get((p[0].source, p[-1].target), 0) + 1
    rows = []
    for p in paths:
        fan = [sizes[e.source] / sizes[e.target] if sizes.get(e.source) is not None and sizes.get(e.target) else 1.0 for e in p]
        product = reduce(lambda a, b: a * b, fan, 1.0)
        rows.append((".".join([p[0].source, *(e.target for e in p)]), " ".join(e.forward for e in p), len(p), float(max(fan)), float(product), sizes.get(p[-1].target), any(e.unique for e in p), any(e.nullable for e in p), ends[p[0].source, p[-1].target] - 1))
    return spark.createDataFrame(rows, "path string, edges string, hops int, fanout_max double, fanout_product double, target_rows long, has_unique boolean, has_nullable boolean, shortcuts int")


#: Columns that a data profile leaves out (fixed values).
SKIPPED = ("last_update", "active", "activebool")


def numeric_bands(catalog: Catalog, frames: Frames, tables: Sequence[str], least_rows: int = 10) -> DataFrame:
    """Mean, sample deviation and the band of one deviation about the mean of numeric columns that are no keys; without those that do not vary."""
    parts = []
    for name in tables:
        t = catalog.table(name)
        skip = {*t.key, *SKIPPED, *(e.column for e in catalog.edges if e.source == name)}
        cols = [c for c, k in t.columns if is_numeric(k) and c not in skip]
        if cols:
            one = frames(name).agg(F.count("*").alias("n"), *(f(F.col(c).cast("double")).alias(f"{x}_{c}") for c in cols for x, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))))
            cells = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"), F.col(f"lo_{c}").alias("min_value"), F.col(f"hi_{c}").alias("max_value")) for c in cols]
            parts.append(one.where(F.col("n") >= least_rows).select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    out = reduce(DataFrame.unionByName, parts).where("std > 0")
    return out.select("table_name", "column_name", F.round("mean", 2).alias("mean"), F.round(F.col("mean") - F.col("std"), 2).alias("low"), F.round(F.col("mean") + F.col("std"), 2).alias("high"), "min_value", "max_value")


def categorical_values(catalog: Catalog, frames: Frames, tables: Sequence[str], most: int = 20, least_rows: int = 10) -> DataFrame:
    """The values, with counts, of text columns of 2 to `most` different ones. A first pass over each table drops columns that a sketch finds far beyond `most`; a second counts the others' values together."""
    parts = []
    for name in tables:
        t = catalog.table(name)
        skip = {*t.key, *SKIPPED, *(e.column for e in catalog.edges if e.source == name)}
        columns = [c for c, k in t.columns if k == "string" and c not in skip]
        if columns:
            about = frames(name).agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
            columns = [c for c in columns if about[c] <= 3 * most]
        if not columns:
            continue
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns))
        counts = frames(name).select(F.explode(cells).alias("x")).groupBy("x.column_name", "x.value").agg(F.count("*").alias("frequency"))
        w = Window.partitionBy("column_name")  # 3 * most values or so
        ok = counts.withColumn("kinds", F.count("value").over(w)).withColumn("rows", F.sum("frequency").over(w)).where(f"value is not null and kinds between 2 and {most} and rows >= {least_rows}")
        parts.append(ok.select(F.lit(name).alias("table_name"), "column_name", "value", "frequency"))
    if not parts:
        raise ValueError("no text column of few values")
    return reduce(DataFrame.unionByName, parts)


def profile_lines(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """table_name, column_name, line: the bands and values of numeric_bands() and categorical_values() as lines to read, commonest values first."""
    bands = numeric.select("table_name", "column_name", F.format_string("- %s.%s: low(<%.2f) mid(%.2f-%.2f) high(>%.2f)", "table_name", "column_name", "low", "low", "high", "high").alias("line"))
    # as many as a categorical column has
    values = F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("n"), "value")))
    items = F.array_join(F.transform(values, lambda x: F.concat(x["value"], F.lit("("), (-x["n"]).cast("string"), F.lit(")"))), ", ")
    kinds = categorical.groupBy("table_name", "column_name").agg(F.count("*").alias("k"), items.alias("items"))
    return bands.unionByName(kinds.select("table_name", "column_name", F.format_string("- %s.%s: %d categories [%s]", "table_name", "column_name", "k", "items").alias("line")))
