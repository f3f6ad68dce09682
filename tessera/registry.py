"""Named queries of the engine over the star tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import canonical, contracts, json_leaves, privacy
from tessera.operators import anchors, budget, dedup, drafts, dsl, explore, near_index
from tessera.operators import calibration as cal
from tessera.operators import registry_ops as reg
from tessera.operators.calculus import Calculus
from tessera.operators.near_index import NearIndex
from tessera.plans.catalog import star_catalog
from tessera.sources import sinks
from tessera.sources.scratch import discard, scratch
from tessera.sources.tables import read_table
from tessera.streaming import flows, stateful, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def frames(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    return cache(lambda name: read_table(spark, root, name))


def calculus(spark: SparkSession, root: str) -> Calculus:
    return Calculus(star_catalog(), frames(spark, root))


def add(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def chain(sql: str, name: str, *steps: tuple, last: tuple, cents: str | None = None) -> None:
    """Registers a query of the calculus: steps build cursors (integers refer to earlier ones), last materializes. cents: a sum of amounts of two places, whose last bits depend on the order of rows, is compared at two places."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        c, made = calculus(spark, root), []
        for method, *arguments in steps:
            made.append(getattr(c, method)(*(made[a[0]] if isinstance(a, tuple) else a for a in arguments)))
        method, *arguments = last
        out = getattr(c, method)(*((made[-1],) if method not in ("read",) else ()), *arguments)
        return out.withColumn(cents, F.round(cents, 2)) if cents else out

    run.__name__ = name
    add(sql)(run)


def spec(sql: str, name: str, query: dict, cents: str | None = None) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        out = dsl.query(star_catalog(), frames(spark, root), query)
        return out.withColumn(cents, F.round(cents, 2)) if cents else out

    run.__name__ = name
    add(sql)(run)


# the calculus

chain("SELECT count(*) AS cnt FROM orders WHERE o_orderstatus = 'F'", "where_eq", ("rows_where", "orders", "o_orderstatus", "eq", "F"), last=("count",))
chain("SELECT count(*) AS cnt FROM customer WHERE c_nationkey IN (1, 5, 7)", "where_in", ("rows_where", "customer", "c_nationkey", "in", [1, "5", 7]), last=("count",))
for _op, _sign in (("lt", "<"), ("gt", ">"), ("lte", "<="), ("gte", ">=")):
    chain(f"SELECT count(*) AS cnt FROM part WHERE p_size {_sign} 20", f"where_{_op}", ("rows_where", "part", "p_size", _op, "20"), last=("count",))
chain("SELECT count(*) AS cnt FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'", "where_range", ("rows_where", "orders", "o_orderdate", "gte", "1995-06-01"), last=("count",))
chain("SELECT count(*) AS cnt FROM customer WHERE c_mktsegment ILIKE '%build%'", "where_like", ("rows_where", "customer", "c_mktsegment", "like", "%build%"), last=("count",))
chain("SELECT DISTINCT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' ORDER BY c_custkey LIMIT 5", "via_forward", ("rows_where", "orders", "o_orderstatus", "eq", "F"), ("rows_via", (0,), "orders.o_custkey->customer"), last=("take", 5))
chain("SELECT DISTINCT o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey LIMIT 5", "via_reverse", ("rows_where", "customer", "c_mktsegment", "eq", "BUILDING"), ("rows_via", (0,), "customer<-orders.o_custkey"), last=("take", 5))
chain("SELECT count(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'", "via_two_hop", ("rows_where", "orders", "o_orderpriority", "eq", "1-URGENT"), ("rows_via", (0,), "orders.o_custkey->customer"), ("rows_via", (1,), "customer.c_nationkey->nation"), last=("count",))
chain("SELECT count(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'", "via_bag_count", ("rows_where", "orders", "o_orderstatus", "eq", "F"), ("rows_via", (0,), "orders.o_custkey->customer"), last=("count",))
chain("SELECT count(*) AS cnt FROM (SELECT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "intersect", ("rows_where", "orders", "o_orderstatus", "eq", "F"), ("rows_via", (0,), "orders.o_custkey->customer"), ("rows_where", "customer", "c_mktsegment", "eq", "BUILDING"), ("intersect", (1,), (2,)), last=("count",))
chain("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 5", "order_take", ("rows_where", "orders", "o_orderstatus", "eq", "O"), ("order_by", (0,), "o_totalprice", "desc"), last=("take", 5))
chain("SELECT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_custkey ORDER BY max(c_acctbal) DESC NULLS FIRST, min(c_name) ASC NULLS LAST, c_custkey LIMIT 5", "take_dedup", ("rows_where", "orders", "o_orderstatus", "eq", "F"), ("rows_via", (0,), "orders.o_custkey->customer"), ("order_by", (1,), "c_name"), ("order_by", (2,), "c_acctbal", "desc"), last=("take", 5))
_LINES = (("rows_where", "orders", "o_orderstatus", "eq", "F"), ("rows_via", (0,), "orders<-lineitem.l_orderkey"))
_JOIN = "FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'"
chain(f"SELECT round(sum(l_extendedprice), 2) AS agg {_JOIN}", "agg_sum", *_LINES, last=("aggregate", "sum", "l_extendedprice"), cents="agg")
chain(f"SELECT avg(l_quantity) AS agg {_JOIN}", "agg_avg", *_LINES, last=("aggregate", "avg", "l_quantity"))
chain(f"SELECT min(l_extendedprice) AS agg {_JOIN}", "agg_min", *_LINES, last=("aggregate", "min", "l_extendedprice"))
chain(f"SELECT max(l_shipdate) AS agg {_JOIN}", "agg_max", *_LINES, last=("aggregate", "max", "l_shipdate"))
chain(f"SELECT l_returnflag AS group_value, count(*) AS agg_value {_JOIN} GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 3", "group_top_count", *_LINES, last=("group_top", "l_returnflag", "count", 3))
chain(f"SELECT l_suppkey AS group_value, sum(l_quantity) AS agg_value {_JOIN} GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 5", "group_top_sum", *_LINES, last=("group_top", "l_suppkey", "sum", 5, "l_quantity"))
chain("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 7 LIMIT 1", "read_row", last=("read", "orders", 7, ["o_orderkey", "o_totalprice", "o_orderstatus"]))
chain("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 1 AND turn = 1 LIMIT 1", "read_composite", last=("read", "conversations", [1, 1], ["conv_id", "turn", "role"]))

# JSON queries

FLAGSHIP = {
    "from": "lineitem",
    "filter": [{"column": "l_returnflag", "op": "in", "value": ["A", "R"]}, {"column": "l_quantity", "op": "gte", "value": 10}],
    "join": [{"via_edge": "lineitem.l_orderkey->orders"}, {"via_edge": "orders.o_custkey->customer"}],
    "group_by": ["c_mktsegment"],
    "aggregate": [{"fn": "count", "alias": "n_items"}, {"fn": "sum", "column": "l_extendedprice", "alias": "revenue"}],
    "sort": [{"column": "revenue", "direction": "desc"}, {"column": "c_mktsegment"}],
}
spec("SELECT c_mktsegment, count(*) AS n_items, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10 GROUP BY 1", "dsl_group_agg", FLAGSHIP, "revenue")
spec("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 50", "dsl_select_chain", {"from": "orders", "filter": [{"column": "o_totalprice", "op": "gt", "value": 300000}], "join": [{"via_edge": "orders.o_custkey->customer"}, {"via_edge": "customer.c_nationkey->nation"}], "select": ["o_orderkey", "c_name", "n_name"], "sort": [{"column": "o_orderkey"}], "limit": 50})
spec("SELECT count(*) AS n, count(l_tax) AS n_tax, min(l_discount) AS lo, max(l_discount) AS hi, avg(l_quantity) AS mean_quantity FROM lineitem", "dsl_global_agg", {"from": "lineitem", "aggregate": [{"fn": "count", "alias": "n"}, {"fn": "count", "column": "l_tax", "alias": "n_tax"}, {"fn": "min", "column": "l_discount", "alias": "lo"}, {"fn": "max", "column": "l_discount", "alias": "hi"}, {"fn": "avg", "column": "l_quantity", "alias": "mean_quantity"}]})
spec("SELECT n_name, count(*) AS n_orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 2 GROUP BY 1", "dsl_reverse_join", {"from": "nation", "filter": [{"column": "n_regionkey", "op": "eq", "value": 2}], "join": [{"via_edge": "nation<-customer.c_nationkey"}, {"via_edge": "customer<-orders.o_custkey"}], "group_by": ["n_name"], "aggregate": [{"fn": "count", "alias": "n_orders"}], "sort": [{"column": "n_orders", "direction": "desc"}, {"column": "n_name"}]})
spec("SELECT c.* FROM orders JOIN customer c ON o_custkey = c_custkey WHERE o_orderkey <= 100", "dsl_default_select", {"from": "orders", "filter": [{"column": "o_orderkey", "op": "lte", "value": 100}], "join": [{"via_edge": "orders.o_custkey->customer"}]})

# exploration

_EDGES = "(VALUES " + ", ".join(f"('{e.source}', '{e.target}', '{e.forward}', '{e.reverse}')" for e in star_catalog().edges) + ") AS e(source, target, forward, reverse)"
_THIRD = max(1, len(star_catalog().tables) // 3)


def _sized(df: DataFrame, spark: SparkSession, root: str, column: str, name: str) -> DataFrame:
    """df, which tells of tables, with how many rows the table in a column has."""
    sizes = explore.table_sizes(star_catalog(), frames(spark, root)).select(F.col("table_name").alias("_t"), F.col("row_count").alias(name))
    return df.join(F.broadcast(sizes), F.col(column) == F.col("_t")).drop("_t")  # as many rows as tables


_SIZES = "(" + " UNION ALL ".join(f"SELECT '{t.name}' AS table_name, count(*) AS row_count FROM {t.name}" for t in star_catalog().tables) + ")"


@add(f"SELECT forward, reverse, source, target, s.row_count AS source_rows, t.row_count AS target_rows FROM {_EDGES} JOIN {_SIZES} s ON s.table_name = source JOIN {_SIZES} t ON t.table_name = target WHERE source IN ('orders', 'customer', 'lineitem', 'nation') AND target IN ('orders', 'customer', 'lineitem', 'nation')")
def schema_map(spark: SparkSession, root: str) -> DataFrame:
    edges = explore.schema_map_frame(spark, star_catalog(), "customer", 1).union(explore.schema_map_frame(spark, star_catalog(), "orders", 1)).distinct()
    return _sized(_sized(edges, spark, root, "source", "source_rows"), spark, root, "target", "target_rows")


@add(f"SELECT d.*, row_count FROM (SELECT t AS table_name, count(*) AS degree FROM (SELECT source AS t FROM {_EDGES} UNION ALL SELECT target FROM {_EDGES}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {_THIRD}) d JOIN {_SIZES} USING (table_name)")
def hubs(spark: SparkSession, root: str) -> DataFrame:
    return _sized(explore.hubs(spark, star_catalog()), spark, root, "table_name", "row_count")


@add(f"SELECT b.*, row_count FROM (SELECT source AS table_name, count(*) AS fk_count FROM {_EDGES} GROUP BY 1 HAVING count(*) >= 2) b JOIN {_SIZES} USING (table_name)")
def bridges(spark: SparkSession, root: str) -> DataFrame:
    return _sized(explore.bridges(spark, star_catalog()), spark, root, "table_name", "row_count")


@add(" UNION ALL ".join(f"SELECT '{t.name}' AS table_name, count(*) AS row_count FROM {t.name}" for t in star_catalog().tables))
def table_sizes(spark: SparkSession, root: str) -> DataFrame:
    return explore.table_sizes(star_catalog(), frames(spark, root))


@add(" UNION ALL ".join(f"SELECT '{t.name}' AS table_name, '{c}' AS column_name, '{k}' AS type, {i + 1} AS ordinal, {str(c in t.key).lower()} AS is_key, {str(any(e.source == t.name and e.column == c for e in star_catalog().edges)).lower()} AS is_foreign_key, count({c}) AS n_values FROM {t.name}" for t in star_catalog().tables for i, (c, k) in enumerate(t.columns)))
def catalog_columns(spark: SparkSession, root: str) -> DataFrame:
    """The catalog's columns, each with its number of values, so that the tables must have them."""
    f, counts = frames(spark, root), None
    for t in star_catalog().tables:
        one = f(t.name).agg(*(F.count(c).alias(c) for c in t.names))
        told = one.select(F.explode(F.array(*(F.struct(F.lit(t.name).alias("t"), F.lit(c).alias("c"), F.col(c).alias("n_values")) for c in t.names))).alias("x")).select("x.*")
        counts = told if counts is None else counts.union(told)
    columns = explore.columns_frame(spark, star_catalog())
    return columns.join(F.broadcast(counts), (F.col("table_name") == F.col("t")) & (F.col("column_name") == F.col("c"))).drop("t", "c")  # as many rows as columns


@add(" UNION ALL ".join(f"SELECT '{e.forward}' AS label, (SELECT count(*) FROM {e.source}) AS source_rows, (SELECT count(*) FROM {e.target}) AS target_rows, (SELECT count(*) FROM {e.source}) / (SELECT count(*) FROM {e.target}) AS fanout" for e in star_catalog().edges))
def fanout(spark: SparkSession, root: str) -> DataFrame:
    return explore.fanout(star_catalog(), frames(spark, root))


@add(" UNION ALL ".join(f"SELECT '{e.forward}' AS label, count(*) AS orphans FROM {e.source} s WHERE s.{e.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {e.target} t WHERE t.{e.target_column} = s.{e.column})" for e in star_catalog().edges))
def fk_orphans(spark: SparkSession, root: str) -> DataFrame:
    return explore.fk_orphans(star_catalog(), frames(spark, root))


@add(" UNION ALL ".join(f"SELECT '{t.name}' AS table_name, count(*) AS duplicates FROM (SELECT 1 FROM {t.name} GROUP BY {', '.join(t.key)} HAVING count(*) > 1)" for t in star_catalog().tables if t.key))
def pk_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return explore.key_duplicates(star_catalog(), frames(spark, root))


@add(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")))
def distinct_counts(spark: SparkSession, root: str) -> DataFrame:
    return explore.distinct_counts(frames(spark, root), "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"])


@add("SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def sample_pk(spark: SparkSession, root: str) -> DataFrame:
    return explore.sample(star_catalog(), frames(spark, root), "customer", 10)


@add("SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '7'), o_orderkey LIMIT 10")
def sample_seeded(spark: SparkSession, root: str) -> DataFrame:
    return explore.sample(star_catalog(), frames(spark, root), "orders", 10, 7, [{"column": "o_orderstatus", "op": "eq", "value": "O"}])


def _profile(table: str, where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count FROM {table} {where}" for c in star_catalog().table(table).names)


@add(_profile("lineitem"))
def profile_table(spark: SparkSession, root: str) -> DataFrame:
    return explore.profile_table(star_catalog(), frames(spark, root), "lineitem")


@add(_profile("orders", "WHERE o_orderstatus = 'F' AND o_totalprice > 100000"))
def profile_filtered(spark: SparkSession, root: str) -> DataFrame:
    return explore.profile_table(star_catalog(), frames(spark, root), "orders", [{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"column": "o_totalprice", "op": "gt", "value": 100000}])


@add("SELECT count(*) AS row_count, count(DISTINCT p_size) AS distinct_count, count(*) - count(p_size) AS null_count, CAST(min(p_size) AS VARCHAR) AS min_value, CAST(max(p_size) AS VARCHAR) AS max_value FROM part")
def profile_column(spark: SparkSession, root: str) -> DataFrame:
    return explore.profile_column(star_catalog(), frames(spark, root), "part", "p_size")


@add("SELECT p_brand AS value, count(*) AS frequency FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_values(spark: SparkSession, root: str) -> DataFrame:
    return explore.top_values(star_catalog(), frames(spark, root), "part", "p_brand", 5)


@add("SELECT 'customer.c_nationkey->nation' AS label, 'ok' AS status, CAST(1 AS BIGINT) AS total, CAST(c_nationkey AS VARCHAR) AS ids FROM customer WHERE c_custkey = 4 UNION ALL SELECT 'customer<-orders.o_custkey', 'ok', count(*), coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_custkey = 4 ORDER BY o_orderkey LIMIT 5)), '') FROM orders WHERE o_custkey = 4")
def neighborhood_edges(spark: SparkSession, root: str) -> DataFrame:
    return explore.neighborhood(star_catalog(), frames(spark, root), "customer", 4)


_DEGREES = " UNION ALL ".join(f"SELECT '{t.name}' AS name, {max(1, sum(e.target == t.name for e in star_catalog().edges))} AS weight, (SELECT count(*) FROM {t.name}) AS n, (SELECT CAST({t.key[0]} AS VARCHAR) FROM {t.name} ORDER BY md5(CAST({t.key[0]} AS VARCHAR) || '11'), {t.key[0]} LIMIT 1) AS row_id" for t in star_catalog().tables if len(t.key) == 1)


@add(f"SELECT name AS table_name, row_id FROM ({_DEGREES}) WHERE n >= 100 ORDER BY -ln((CAST('0x' || substr(md5(name || '11'), 1, 12) AS BIGINT) + 0.5) / pow(2, 48)) / weight, name LIMIT 1")
def random_anchor(spark: SparkSession, root: str) -> DataFrame:
    f = frames(spark, root)
    sizes = {r["table_name"]: r["row_count"] for r in explore.table_sizes(star_catalog(), f).collect()}
    name, row = explore.random_anchor(star_catalog(), f, sizes, 11)
    return row.select(F.lit(name).alias("table_name"), F.col(row.columns[0]).cast("string").alias("row_id"))


@add("SELECT path, edges, hops, row_count AS end_rows FROM (WITH RECURSIVE n AS (" + f"SELECT source, target, forward, source || '.' || target AS path, forward AS edges, 1 AS hops FROM {_EDGES} UNION ALL SELECT n.source, e.target, e.forward, n.path || '.' || e.target, n.edges || ' ' || e.forward, n.hops + 1 FROM n JOIN {_EDGES} ON e.source = n.target WHERE n.hops < 3) SELECT target, path, edges, hops FROM n) JOIN {_SIZES} ON table_name = target")
def path_catalog(spark: SparkSession, root: str) -> DataFrame:
    paths = explore.path_features(spark, star_catalog(), {}, 3).select("path", "edges", "hops")
    return _sized(paths.withColumn("_end", F.element_at(F.split("path", "\\."), -1)), spark, root, "_end", "end_rows").drop("_end")


_FLAGGED = "(VALUES " + ", ".join(f"('{e.source}', '{e.target}', '{e.forward}', {str(e.unique).lower()}, {str(e.nullable).lower()})" for e in star_catalog().edges) + ") AS e(source, target, forward, u, o)"
_STEPS = f"(SELECT e.*, s.row_count / t.row_count AS fan, t.row_count AS rows FROM {_FLAGGED} JOIN ({SQL['table_sizes']}) s ON s.table_name = e.source JOIN ({SQL['table_sizes']}) t ON t.table_name = e.target)"


@add(f"WITH RECURSIVE n AS (SELECT source, target, source || '.' || target AS path, forward AS edges, 1 AS hops, fan AS fanout_max, fan AS fanout_product, rows AS target_rows, u AS has_unique, o AS has_nullable FROM {_STEPS} UNION ALL SELECT n.source, e.target, n.path || '.' || e.target, n.edges || ' ' || e.forward, n.hops + 1, greatest(n.fanout_max, e.fan), n.fanout_product * e.fan, e.rows, n.has_unique OR e.u, n.has_nullable OR e.o FROM n JOIN {_STEPS} e ON e.source = n.target WHERE n.hops < 3) SELECT path, edges, CAST(hops AS INT) AS hops, fanout_max, round(fanout_product, 9) AS fanout_product, target_rows, has_unique, has_nullable, CAST(count(*) OVER (PARTITION BY source, target) - 1 AS INT) AS shortcuts FROM n")
def path_features(spark: SparkSession, root: str) -> DataFrame:
    sizes = {r["table_name"]: r["row_count"] for r in explore.table_sizes(star_catalog(), frames(spark, root)).collect()}
    return explore.path_features(spark, star_catalog(), sizes, 3).withColumn("fanout_product", F.round("fanout_product", 9))


def _band(table: str, c: str) -> str:
    return f"SELECT '{table}' AS table_name, '{c}' AS column_name, round(avg({c}), 2) AS mean, round(avg({c}) - stddev_samp({c}), 2) AS low, round(avg({c}) + stddev_samp({c}), 2) AS high, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM {table}"


@add(" UNION ALL ".join(_band(*x) for x in (("customer", "c_acctbal"), ("part", "p_size"), ("part", "p_retailprice"))))
def numeric_bands(spark: SparkSession, root: str) -> DataFrame:
    return explore.numeric_bands(star_catalog(), frames(spark, root), ["customer", "part"])


@add("WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS frequency FROM {t} GROUP BY {c}" for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("customer", "c_name"), ("customer", "c_mktsegment"))) + "), k AS (SELECT table_name, column_name, count(value) AS kinds FROM c GROUP BY 1, 2) SELECT c.* FROM c JOIN k USING (table_name, column_name) WHERE kinds BETWEEN 2 AND 20 AND value IS NOT NULL")
def categorical_topk(spark: SparkSession, root: str) -> DataFrame:
    return explore.categorical_values(star_catalog(), frames(spark, root), ["orders", "customer"])


@add("SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '[INTERNAL]' END AS c_name, CASE WHEN c_acctbal IS NOT NULL THEN '[REDACTED]' END AS c_acctbal, c_mktsegment FROM customer")
def redact(spark: SparkSession, root: str) -> DataFrame:
    labels = {"c_custkey": privacy.VISIBLE, "c_name": privacy.INTERNAL, "c_acctbal": privacy.BLOCKED, "c_mktsegment": privacy.VISIBLE}
    return privacy.redact(read_table(spark, root, "customer").select(*labels), labels)


# registry

@add("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_by_key(spark: SparkSession, root: str) -> DataFrame:
    return reg.latest_by_key(read_table(spark, root, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


def _parts(spark: SparkSession, root: str, parts: int) -> list[DataFrame]:
    """All events in batches, as they might come in."""
    events = read_table(spark, root, "events")
    return [events.where(F.pmod("event_id", F.lit(parts)) == k) for k in range(parts)]


@add(SQL["latest_by_key"])
def upsert_replayed(spark: SparkSession, root: str) -> DataFrame:
    # batches arrive as files of a stream; then two of them come again
    arriving, table, columns = scratch(spark, "arriving"), scratch(spark, "upserted"), ["user_id", "event_id", "event_type", "ts"]
    batches = [part.select(*columns) for part in _parts(spark, root, 4)]
    for part in batches:
        part.write.mode("append").parquet(arriving)
    sink = lambda batch, number: sinks.upsert(batch, number, table, ["user_id"], ["ts", "event_id"])
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    query = sinks.stream_into(stream, sink, scratch(spark, "upsert-checkpoint"))
    query.awaitTermination()
    sink(batches[1], 1)
    sink(batches[0], 0)
    return sinks.read_upserted(spark, table).select(*columns)


@add("SELECT row_number() OVER (ORDER BY event_id % 4, ts, event_id) AS log_id, event_id, event_type FROM events")
def event_log_ids(spark: SparkSession, root: str) -> DataFrame:
    path = scratch(spark, "event-log")
    for number in (0, 1, 2, 1, 3, 0):  # two of them come again
        sinks.append(_parts(spark, root, 4)[number].select("event_id", "event_type", "ts"), number, path, ["ts", "event_id"])
    return sinks.read_appended(spark, path).select("log_id", "event_id", "event_type")


@add("SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL")
def registry_commit(spark: SparkSession, root: str) -> DataFrame:
    # one bundle for each language; one of them is tried again, and one fails its check
    docs, path = read_table(spark, root, "documents").select("doc_id", "lang", "source"), scratch(spark, "registry")
    sizes = {r["lang"]: r["n"] for r in docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as languages

    def check(n: int) -> Callable[[DataFrame], str | None]:
        return lambda rows: None if rows.count() == n else "rows are missing"

    out = docs.limit(0)
    for lang, n in sorted(sizes.items()):
        out = out.union(spark.read.parquet(sinks.commit_bundle(docs.where(F.col("lang") == lang), path, lang, check(n))))
    for lang, n, rows in ((min(sizes), sizes[min(sizes)], docs), ("incomplete", -1, docs)) if sizes else ():
        try:
            sinks.commit_bundle(rows, path, lang, check(n))
        except sinks.CommitError:
            continue
        raise AssertionError("a bundle was committed that should not have been")
    return out


@add("SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'signup' ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 20")
def registry_list(spark: SparkSession, root: str) -> DataFrame:
    return reg.listing(read_table(spark, root, "events").select("event_id", "user_id", "event_type", "ts"), 20, "ts", "event_id", {"event_type": "signup"})


@add("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def coverage(spark: SparkSession, root: str) -> DataFrame:
    return reg.coverage(read_table(spark, root, "documents"), ["lang", "source"])


@add("SELECT g.lang, g.source, coalesce(c.n, 0) AS n, CAST(greatest(0, 25 - coalesce(c.n, 0)) AS BIGINT) AS deficit FROM (SELECT DISTINCT lang, source FROM documents) g LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents WHERE n_chars > 1000 GROUP BY 1, 2) c USING (lang, source)")
def coverage_deficit(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    return reg.deficits(docs, reg.coverage(docs.where("n_chars > 1000"), ["lang", "source"]), ["lang", "source"], 25)


@add("SELECT lang, source, n, total FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), (SELECT count(*) AS total FROM documents)")
def registry_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return reg.snapshot(read_table(spark, root, "documents"), ["lang", "source"])


@add("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS signature FROM documents GROUP BY 2")
def exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return dedup.exact_dedup(read_table(spark, root, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", "signature")


_GRAMS = "CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


@add(f"WITH d AS (SELECT doc_id, lang, list_sort(list_distinct({_GRAMS})) AS g FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)), r AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, md5(array_to_string(g, '|'))) AS rep FROM d WHERE len(g) > 0), s AS (SELECT doc_id, lang, len(g) AS n, unnest(g) AS g FROM r WHERE doc_id = rep), p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS m, y.n, count(*) AS c FROM s x JOIN s y ON x.lang = y.lang AND x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) SELECT a, b, c / (m + n - c) AS similarity FROM p WHERE c / (m + n - c) >= 0.9 UNION ALL SELECT rep, doc_id, 1.0 FROM r WHERE doc_id <> rep")
def near_dup_verified(spark: SparkSession, root: str) -> DataFrame:
    return dedup.near_pairs(read_table(spark, root, "documents"), "doc_id", "text", ["lang"], word="[a-z0-9_]+")


_EARLIER = f"WITH d AS (SELECT doc_id, lang, list_sort(list_distinct({_GRAMS})) AS g FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)), r AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, md5(array_to_string(g, '|'))) AS rep FROM d WHERE len(g) > 0), s AS (SELECT doc_id, lang, len(g) AS n, unnest(g) AS g FROM r WHERE doc_id = rep), p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS m, y.n, count(*) AS c FROM s x JOIN s y ON x.lang IS NOT DISTINCT FROM y.lang AND x.g = y.g AND x.doc_id < y.doc_id AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n GROUP BY ALL), near AS (SELECT a, b, c / (m + n - c) AS similarity FROM p WHERE c / (m + n - c) >= 0.9 UNION ALL SELECT rep, doc_id, 1.0 FROM r WHERE doc_id <> rep)"


@add(f"{_EARLIER} SELECT d.doc_id AS id, n.a AS match, n.similarity FROM documents d LEFT JOIN (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY b ORDER BY similarity DESC, a) = 1) n ON n.b = d.doc_id")
def near_dup_lookup(spark: SparkSession, root: str) -> DataFrame:
    # all documents come in three batches, by doc_id, into an index that starts empty
    docs = read_table(spark, root, "documents")
    index = NearIndex(spark, scratch(spark, "near-index"), "bigint", word="[a-z0-9_]+")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    out = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("match"), F.lit(None).cast("double").alias("similarity")).limit(0)
    for k in range(3) if lo is not None else ():
        place = F.floor((F.col("doc_id") - lo) * 3 / (hi - lo + 1))
        out = out.union(index.add(docs.where(place == k), k, "doc_id", "doc_id", "text", ["lang"]))
    discard(spark, index.path)  # what was said is written by itself
    return out


_GREEDY = f"WITH RECURSIVE {_EARLIER.removeprefix('WITH ')}, o AS MATERIALIZED (SELECT b, row_number() OVER (ORDER BY b) AS i, list(a) AS before FROM near GROUP BY b), f AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT o.i, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, b) ELSE gone END FROM f JOIN o ON o.i = f.i + 1)"


@add(f"{_GREEDY} SELECT doc_id, lang, NOT list_contains((SELECT gone FROM f ORDER BY i DESC LIMIT 1), doc_id) AS kept FROM documents")
def near_dup_kept(spark: SparkSession, root: str) -> DataFrame:
    # registered one by one: a document is refused if one that was kept before is near it
    docs = read_table(spark, root, "documents").select("doc_id", "text", "lang")
    pairs = dedup.near_pairs(docs, "doc_id", "text", ["lang"], word="[a-z0-9_]+").select("a", "b")
    return near_index.decide(docs.select("doc_id", "lang"), pairs, "doc_id")


@add()
def minhash_pairs(spark: SparkSession, root: str) -> DataFrame:
    return dedup.near_pairs(read_table(spark, root, "documents"), "doc_id", "text", ["lang"], verify=False)


@add("SELECT item_id, len(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS n_shingles FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark)")
def shingle_counts(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "benchmark").select("item_id", F.size(dedup.shingles(F.col("text"), word="[a-z0-9_]+")).cast("bigint").alias("n_shingles"))


@add("SELECT o_custkey AS run_id, count(*) AS total, count_if(o_orderstatus = 'F') AS accepted, count_if(o_orderstatus = 'P') AS rejected, count_if(o_orderstatus NOT IN ('F', 'P')) AS other, coalesce((SELECT count(*) FROM lineitem JOIN orders i ON l_orderkey = i.o_orderkey WHERE i.o_custkey = o.o_custkey), 0) AS verification_results, (SELECT count(*) FROM events WHERE user_id = o.o_custkey) AS event_count FROM orders o GROUP BY 1")
def run_summary(spark: SparkSession, root: str) -> DataFrame:
    # customers stand for runs, their orders for tasks, the lines of these for verifications
    orders = read_table(spark, root, "orders")
    checks = read_table(spark, root, "lineitem").join(orders.select("o_orderkey", F.col("o_custkey").alias("run_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    events = read_table(spark, root, "events").withColumnRenamed("user_id", "run_id")
    return reg.run_summaries(orders.withColumnRenamed("o_custkey", "run_id"), checks, events, "run_id", "o_orderstatus", "F", "P")


@add("SELECT count(*) AS total, count_if(event_type = 'purchase') AS accepted, count_if(event_type = 'error') AS rejected, count_if(event_type NOT IN ('purchase', 'error')) AS other FROM events")
def status_counts(spark: SparkSession, root: str) -> DataFrame:
    return reg.run_summary(read_table(spark, root, "events"), "event_type", "purchase", "error")


@add("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def checkpoint_anti(spark: SparkSession, root: str) -> DataFrame:
    return reg.unprocessed(read_table(spark, root, "documents").select("doc_id", "lang"), read_table(spark, root, "labels"), "doc_id", "doc_id")


#: Each user's events as entries: views and signups reserve, others settle or release what the event before them reserved.
_ENTRIES = "(SELECT event_id, user_id, row_number() OVER w AS r, CASE WHEN event_type IN ('view', 'signup') THEN 'reserve' WHEN event_type = 'error' THEN 'release' ELSE 'settle' END AS kind, CASE WHEN event_type IN ('view', 'signup') THEN event_id ELSE lag(event_id) OVER w END AS reservation, CASE WHEN event_type IN ('view', 'signup') THEN floor(value) WHEN event_id % 4 > 0 THEN floor(value / 2) END AS compose, CAST(event_id % 5 AS DOUBLE) AS solve, CASE WHEN event_type IN ('view', 'signup') THEN CAST(event_id % 3 AS DOUBLE) END AS gpu FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_LIMIT, _GPU = 400, 25
_FITS = f"(n.kind = 'reserve' AND f.spent_compose + f.spent_solve + f.reserved_compose + f.reserved_solve + n.compose + n.solve <= {_LIMIT} AND f.spent_gpu + f.reserved_gpu + n.gpu <= {_GPU})"
_CLOSES = "(n.kind <> 'reserve' AND f.status = 'reserved')"


def _folded(p: str) -> str:
    spends = f"f.spent_{p} + CASE WHEN {_CLOSES} AND n.kind = 'settle' THEN coalesce(n.{p}, f.own_{p}) ELSE 0 END"
    return f"{spends}, f.reserved_{p} + CASE WHEN {_FITS} THEN n.{p} WHEN {_CLOSES} THEN -f.own_{p} ELSE 0 END, CASE WHEN {_FITS} THEN n.{p} ELSE 0 END"


@add(f"WITH RECURSIVE e AS {_ENTRIES}, f(user_id, r, event_id, status, spent_compose, reserved_compose, own_compose, spent_solve, reserved_solve, own_solve, spent_gpu, reserved_gpu, own_gpu) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', {', '.join(['0::DOUBLE'] * 9)} FROM e UNION ALL SELECT n.user_id, n.r, n.event_id, CASE WHEN {_FITS} THEN 'reserved' WHEN n.kind = 'reserve' THEN 'refused' WHEN {_CLOSES} AND n.kind = 'settle' THEN 'settled' WHEN {_CLOSES} THEN 'released' ELSE 'unknown' END, {', '.join(_folded(p) for p in budget.PHASES)} FROM f JOIN e n ON n.user_id = f.user_id AND n.r = f.r + 1) SELECT event_id, status, spent_compose, spent_solve, spent_gpu, reserved_compose, reserved_solve, reserved_gpu FROM f WHERE r > 0")
def budget_ledger(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    holds = F.col("event_type").isin("view", "signup")
    rows = read_table(spark, root, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.when(holds, "reserve").when(F.col("event_type") == "error", "release").otherwise("settle").alias("kind"),
        F.when(holds, F.col("event_id")).otherwise(F.lag("event_id").over(w)).alias("reservation"),
        F.when(holds, F.floor("value")).when(F.col("event_id") % 4 > 0, F.floor(F.col("value") / 2)).alias("compose"),
        (F.col("event_id") % 5).alias("solve"),
        F.when(holds, F.col("event_id") % 3).alias("gpu"),
    )
    told = budget.ledger(rows, "user_id", ["ts", "event_id"], "kind", "reservation", budget.PHASES, _LIMIT, _GPU)
    return told.select("event_id", "status", *(f"{w}_{p}" for w in ("spent", "reserved") for p in budget.PHASES))


@add("SELECT user_id, count_if(event_type = 'purchase') AS accepted, count(*) AS attempted, count(*) >= 5 AND count_if(event_type = 'purchase') / count(*) < 0.2 AS abort FROM events GROUP BY 1")
def budget_abort(spark: SparkSession, root: str) -> DataFrame:
    counts = read_table(spark, root, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.count("*").alias("attempted"))
    return counts.withColumn("abort", budget.should_abort(F.col("accepted"), F.col("attempted"), 0.2, 5))


# calibration: users are tasks, their events are runs

_PASS = "SELECT user_id, count_if(event_type <> 'error') AS n, count_if(event_type = 'purchase') AS passes FROM events GROUP BY 1"


def _rates(spark: SparkSession, root: str) -> DataFrame:
    return cal.pass_rates(read_table(spark, root, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


@add(f"SELECT user_id, n, passes, CASE WHEN n > 0 THEN passes / n ELSE 0.0 END AS pass_rate FROM ({_PASS})")
def pass_rate(spark: SparkSession, root: str) -> DataFrame:
    return _rates(spark, root)


def _intervals(most: int) -> str:
    """Both ends by 50 halvings, in SQL, on binomial tails from logarithms of factorials."""
    tail = "list_sum(list_transform(range({k}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
    halve = "list_reduce(list_prepend(0.5::DOUBLE, list_transform(range(2, 52), lambda j: pow(0.5, j))), lambda p, w: CASE WHEN {tail} < {at} THEN p + w ELSE p - w END)"
    ends = [halve.format(tail=tail.format(k=k, p="p"), at=at) for k, at in (("passes", "0.05"), ("passes + 1", "0.95"))]
    return f"(SELECT n, passes, CASE WHEN passes = 0 THEN 0.0 ELSE round({ends[0]}, 6) END AS ci_low, CASE WHEN passes = n THEN 1.0 ELSE round({ends[1]}, 6) END AS ci_high FROM (SELECT CAST(n AS INT) AS n, CAST(unnest(range(n + 1)) AS INT) AS passes FROM range({most + 1}) t(n))) AS i"


_OUTCOMES = "SELECT CAST(n AS INT) AS n, CAST(passes AS INT) AS passes, count(*) AS users FROM (SELECT user_id, count(*) AS n, count_if(event_type = 'purchase') AS passes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r <= 12 GROUP BY 1) GROUP BY 1, 2"


@add(f"SELECT o.*, i.ci_low, i.ci_high FROM ({_OUTCOMES}) o JOIN {_intervals(12)} ON i.n = o.n AND i.passes = o.passes")
def cp_interval(spark: SparkSession, root: str) -> DataFrame:
    """The interval of every outcome that users have in their first 12 runs."""
    seen = _first(spark, root, 12).groupBy(F.col("n").cast("int").alias("n"), F.col("passes").cast("int").alias("passes")).agg(F.count("*").alias("users"))
    return seen.join(F.broadcast(cal.interval_table(spark, 12)), ["n", "passes"])  # 91 rows


def _possible(total: str) -> str:
    return f"CASE WHEN (passes + {total} - n) / {total} < 0.2 THEN 'too_hard' WHEN passes / {total} > 0.8 THEN 'too_easy' WHEN passes / {total} >= 0.2 AND (passes + {total} - n) / {total} <= 0.8 THEN 'accept' ELSE 'continue' END"


_SIX = "SELECT user_id, count(*) AS n, count_if(event_type = 'purchase') AS passes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r <= 5 GROUP BY 1"


def _first(spark: SparkSession, root: str, most: int) -> DataFrame:
    rows = read_table(spark, root, "events").where("event_type <> 'error'")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("passes"))


@add(f"SELECT user_id, n, passes, {_possible('6')} AS decision FROM ({_SIX})")
def early_stop(spark: SparkSession, root: str) -> DataFrame:
    return _first(spark, root, 5).withColumn("decision", cal.possible(F.lit(6), F.col("n"), F.col("passes"), 0.2, 0.8))


_DECIDED = f"SELECT user_id, n, passes, CASE WHEN sure <> 'continue' THEN sure WHEN ci_high < 0.2 THEN 'too_hard' WHEN ci_low > 0.8 THEN 'too_easy' WHEN ci_low >= 0.2 AND ci_high <= 0.8 THEN 'accept' ELSE 'continue' END AS decision FROM (SELECT s.*, i.ci_low, i.ci_high, {_possible('6').replace('passes', 's.passes').replace(' n)', ' s.n)')} AS sure FROM ({_SIX}) s JOIN {_intervals(12)} ON s.n = i.n AND s.passes = i.passes)"


def _decided(spark: SparkSession, root: str) -> DataFrame:
    rows = _first(spark, root, 5)
    ci = cal.interval_table(spark, 12).withColumnRenamed("n", "m").withColumnRenamed("passes", "p")
    rows = rows.join(F.broadcast(ci), (F.col("n") == F.col("m")) & (F.col("passes") == F.col("p")))  # 91 rows
    return rows.withColumn("decision", cal.decide(F.col("ci_low"), F.col("ci_high"), cal.possible(F.lit(6), F.col("n"), F.col("passes"), 0.2, 0.8), 0.2, 0.8)).select("user_id", "n", "passes", "decision")


@add(_DECIDED)
def calibration_decision(spark: SparkSession, root: str) -> DataFrame:
    return _decided(spark, root)


_DIVERGENCE = "SELECT user_id, count(*) AS submissions, count(DISTINCT CAST(json(props) AS VARCHAR)) AS answers, count(DISTINCT CAST(json(props) AS VARCHAR)) / count(*) AS divergence FROM events WHERE coalesce(props, '') <> '' GROUP BY 1"


@add(_DIVERGENCE)
def divergence(spark: SparkSession, root: str) -> DataFrame:
    return cal.divergence(read_table(spark, root, "events"), "user_id", "props")


@add(f"SELECT user_id, passes, CASE WHEN divergence > 0.9 THEN 'divergent' WHEN decision <> 'continue' THEN decision WHEN passes / n < 0.2 THEN 'too_hard' WHEN passes / n > 0.8 THEN 'too_easy' ELSE 'accept' END AS verdict FROM ({_DECIDED}) JOIN ({_DIVERGENCE}) USING (user_id)")
def quality_gate(spark: SparkSession, root: str) -> DataFrame:
    rows = _decided(spark, root).join(divergence(spark, root), "user_id")
    return rows.select("user_id", "passes", cal.gate(F.col("decision"), F.col("passes") / F.col("n"), F.col("divergence"), 0.2, 0.8, 0.9).alias("verdict"))


@add("WITH r AS (SELECT user_id, row_number() OVER w AS n, sum(CAST(event_type = 'purchase' AS INT)) OVER w AS passes FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM r WHERE n <= 6), d AS (SELECT user_id, n, passes, " + _possible("6") + " AS decision FROM c WHERE n % 3 = 0 OR n = m) SELECT user_id, n AS runs_used, CAST(passes AS BIGINT) AS passes, decision FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN decision <> 'continue' THEN 0 ELSE 1 END, CASE WHEN decision <> 'continue' THEN n ELSE -n END) AS k FROM d) WHERE k = 1")
def early_stop_batches(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "events").where("event_type <> 'error'")
    return cal.batched(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 6, 3, 0.2, 0.8).withColumn("runs_used", F.col("runs_used").cast("bigint"))


# flows

_ROLLING = "SELECT event_id, event_type, ts, event_type = 'error' AS failed, count(*) OVER w AS n, count_if(event_type = 'error') OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"


@add(f"SELECT event_id, n, errors, errors / n AS rate FROM ({_ROLLING})")
def breaker_rolling(spark: SparkSession, root: str) -> DataFrame:
    return flows.rolling_errors(read_table(spark, root, "events"), "user_id", "ts", F.col("event_type") == "error", 86_400).select("event_id", "n", "errors", "rate")


@add(f"SELECT event_id, n, errors FROM ({_ROLLING}) WHERE failed AND n >= 2 AND errors / n >= 0.5")
def breaker_openings(spark: SparkSession, root: str) -> DataFrame:
    return flows.breaker_openings(read_table(spark, root, "events"), "user_id", "ts", F.col("event_type") == "error", 86_400, 2, 0.5).select("event_id", "n", "errors")


@add("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, sum(CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT user_id, count(*) AS run_length, min(i) AS first_pos, max(i) AS last_pos FROM r WHERE event_type IN ('error', 'view') GROUP BY user_id, g")
def backoff_runs(spark: SparkSession, root: str) -> DataFrame:
    return flows.runs(read_table(spark, root, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "view"))


_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, epoch_us(ts) AS t FROM events)"
_WINDOWED = "x AS (SELECT e.user_id, e.r, e.t, e.event_id, e.event_type = 'error' AS bad, count(*) AS n, count_if(p.event_type = 'error') AS errors FROM o e JOIN o p ON p.user_id = e.user_id AND p.r <= e.r AND p.t >= e.t - 86400000000 GROUP BY ALL)"


@add(f"WITH RECURSIVE {_ORDERED}, {_WINDOWED}, f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS until, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS errors FROM o UNION ALL SELECT x.user_id, x.r, x.event_id, CASE WHEN x.bad AND x.n >= 3 AND x.errors / x.n >= 0.4 THEN x.t + 21600000000 WHEN NOT x.bad AND x.t >= f.until THEN NULL ELSE f.until END, x.t, x.n, x.errors FROM f JOIN x ON x.user_id = f.user_id AND x.r = f.r + 1) SELECT event_id, n, errors, errors / n AS error_rate, CASE WHEN until IS NULL THEN 'closed' WHEN t < until THEN 'open' ELSE 'probe' END AS state, until IS NULL OR t >= until AS available, CASE WHEN t < until THEN (until - t) / 1000000 ELSE 0.0 END AS cooldown_remaining_s FROM f WHERE r > 0")
def breaker_states(spark: SparkSession, root: str) -> DataFrame:
    out = states.breaker_states(read_table(spark, root, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 86_400, 3, 0.4, 21_600)
    return out.select("event_id", "n", "errors", "error_rate", "state", "available", "cooldown_remaining_s")


@add(f"WITH RECURSIVE {_ORDERED}, f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS c, CAST(NULL AS BIGINT) AS until FROM o UNION ALL SELECT o.user_id, o.r, o.event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN 0 WHEN o.t >= f.until THEN 1 ELSE f.c + 1 END, CASE WHEN event_type IN ('error', 'view') AND (CASE WHEN o.t >= f.until THEN 0 ELSE f.c END) + 1 >= 3 THEN o.t + 64800000000 END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1) SELECT event_id, c AS discards, until / 1000000 AS backoff_until FROM f WHERE r > 0")
def backoff_states(spark: SparkSession, root: str) -> DataFrame:
    out = states.backoff_states(read_table(spark, root, "events"), "user_id", "ts", "event_id", F.col("event_type").isin("error", "view"), 3, 64_800)
    return out.select("event_id", "discards", "backoff_until")


def _by_time(spark: SparkSession, root: str, flag: Column, parts: int = 3) -> list[DataFrame]:
    """Events as the streams take them, in parts that follow each other in time."""
    rows = read_table(spark, root, "events").select(F.col("user_id").cast("string").alias("key"), states.micros("ts").alias("ts"), F.col("event_id").alias("tie"), flag.alias("flag")).where("ts is not null")
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    place = F.floor((F.col("ts") - (lo or 0)) * parts / ((hi or 0) - (lo or 0) + 1))
    return [rows.where(place == k) for k in range(parts)]


@add(f"SELECT event_id, n, errors, state FROM ({SQL['breaker_states']})")
def breaker_stream(spark: SparkSession, root: str) -> DataFrame:
    check = stateful.Breaker(86_400_000_000, 3, 0.4, 21_600_000_000)
    out = stateful.over_split(spark, _by_time(spark, root, F.col("event_type") == "error"), check, scratch(spark, "breaker-stream"))
    return out.select(F.col("tie").alias("event_id"), "n", "errors", "state")


@add(SQL["backoff_states"])
def backoff_stream(spark: SparkSession, root: str) -> DataFrame:
    check = stateful.Backoff(3, 64_800_000_000)
    out = stateful.over_split(spark, _by_time(spark, root, F.col("event_type").isin("error", "view")), check, scratch(spark, "backoff-stream"))
    return out.select(F.col("tie").alias("event_id"), "discards", (F.col("until") / 1_000_000).alias("backoff_until"))


@add("SELECT event_id, user_id, gap_seconds FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000 AS gap_seconds FROM events) WHERE gap_seconds > 86400")
def stall_gaps(spark: SparkSession, root: str) -> DataFrame:
    return flows.stalls(read_table(spark, root, "events"), "user_id", "ts", "event_id", 86_400).select("event_id", "user_id", "gap_seconds")


@add("SELECT conv_id, count(*) AS events, min(turn) AS lo, max(turn) AS hi, count(DISTINCT turn) AS kinds FROM conversations GROUP BY 1 HAVING min(turn) <> 1 OR max(turn) <> count(*) OR count(DISTINCT turn) <> count(*)")
def event_seq_check(spark: SparkSession, root: str) -> DataFrame:
    return flows.sequence_faults(read_table(spark, root, "conversations"), "conv_id", "turn")


# answers

_ANSWER = canonical.Field("object", fields=(canonical.Field("int", "k"), canonical.Field("list", "tags", items=canonical.Field("string"), unique=True)))


@add("SELECT event_id, CASE WHEN status = 'matched' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, status FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'decode_failed' WHEN event_id % 7 = 1 THEN 'schema_mismatch' WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'matched' ELSE 'em_mismatch' END AS status FROM events)")
def answer_rewards(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    given = F.format_string('{"tags": ["b", "%s", "b"], "k": %d}', "event_type", k)
    given = F.when(F.col("event_id") % 7 == 0, F.substring(given, 1, 9)).when(F.col("event_id") % 7 == 1, F.replace(given, F.lit('"k": '), F.lit('"k": 0.'))).otherwise(given)
    rows = read_table(spark, root, "events").select("event_id", given.alias("given"), F.format_string('{"k": %d, "tags": ["%s", "b"]}', k + k % 2, "event_type").alias("expected"))
    return contracts.rewards(rows, "given", "expected", _ANSWER).select("event_id", "reward", "status")


@add("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def canonical_lists(spark: SparkSession, root: str) -> DataFrame:
    # of the event types, of which there are five
    return read_table(spark, root, "events").groupBy("user_id").agg(F.array_join(canonical.canonical_list(F.collect_set("event_type"), True), ",").alias("kinds"))


@add("SELECT k || ':' || CASE WHEN json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN json_type(props, '$.' || k) = 'DOUBLE' THEN 'float' ELSE 'string' END AS path, count(*) AS answers FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def inferred_schema(spark: SparkSession, root: str) -> DataFrame:
    return contracts.inferred_paths(read_table(spark, root, "events"), "props").withColumnRenamed("n", "answers")


# drafts and registered tasks: events and documents stand for them

_PEOPLE = "customer|user|member|account|profile|person|staff|employee|contact|address|patient|student|teacher"
_SHOWN = "name|title|label|status|type|kind|category|language|code|rating|mode|method|channel|plan|tier|level"
_HIDDEN = ("ssn|social_security|passport|tax_id|cvv|pin|password|secret|token|api_key|private_key|credit_card|card_number|bank_account|iban|routing_number", "email|e_mail|phone|mobile|telephone|fax|address|street|zipcode|postal_code|postcode|city|state|province|country|birth|birthdate|birthday|dob|first_name|last_name|full_name")


@add(" UNION ALL ".join(f"SELECT '{t.name}' AS table_name, c AS column_name, d AS default_label, CASE WHEN t || '.' || c = 'orders.o_comment' THEN 'internal' WHEN regexp_matches(c, '(^|_)({_HIDDEN[0]})($|_)') THEN 'blocked' WHEN regexp_matches(c, '(^|_)({_HIDDEN[1]})($|_)') THEN 'internal' WHEN d = 'blocked' AND NOT regexp_matches(t, '(^|_)({_PEOPLE})($|_)') AND regexp_matches(c, '(^|_)({_SHOWN})($|_)') THEN 'internal' ELSE d END AS label, n AS shown FROM (SELECT '{t.name}' AS t, unnest([{', '.join(f'{chr(39)}{c}{chr(39)}' for c in t.names)}]) AS c, unnest([{', '.join(f'(SELECT count({c}) FROM {t.name})' for c in t.names)}]) AS n), (VALUES ('user_visible'), ('internal'), ('blocked')) v(d)" for t in star_catalog().tables if t.name in ("customer", "orders", "part", "supplier", "nation")))
def column_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of the tables' own columns under each default, and how many values a label covers."""
    f, out = frames(spark, root), None
    for name in ("customer", "orders", "part", "supplier", "nation"):
        told = privacy.labelled(f(name), name, ("user_visible", "internal", "blocked"), {"orders.o_comment": privacy.INTERNAL})
        out = told if out is None else out.union(told)
    return out


_DRAFT = "SELECT event_id, event_type AS topic, CASE WHEN event_id % 7 = 0 THEN '[1]' ELSE '{\"user\": ' || user_id || '}' END AS anchor, props AS answer, CASE event_id % 5 WHEN 0 THEN 'Which?' WHEN 1 THEN '<entity>' || chr(10) || '{\"user\": 0}' || chr(10) || '</entity>' || chr(10) || chr(10) || 'Which?' ELSE '<entity>' || chr(10) || '{\"user\": ' || user_id || '}' || chr(10) || '</entity>' || chr(10) || chr(10) || 'What did it do?' END AS question, user_id FROM events"


def _drafts(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events").selectExpr("event_id", "event_type AS topic", "CASE WHEN event_id % 7 = 0 THEN '[1]' ELSE concat('{\"user\": ', user_id, '}') END AS anchor", "props AS answer", "CASE event_id % 5 WHEN 0 THEN 'Which?' WHEN 1 THEN '<entity>\\n{\"user\": 0}\\n</entity>\\n\\nWhich?' ELSE concat('<entity>\\n{\"user\": ', user_id, '}\\n</entity>\\n\\nWhat did it do?') END AS question", "CAST(NULL AS STRING) AS observed")


#: What each draft, by its number, has wrong with it; drafts beyond these have nothing.
_FAULTS = ("topic_required", "anchor_entity_required", "anchor_entity_scalar_map_required", "canonical_answer_json_invalid", "question_required", "question_entity_block_required", "question_entity_block_invalid_json", "question_entity_block_mismatch", "question_body_required", "question_raw_identifier_leak", "question_entity_placeholder_forbidden", "label_blank_string_forbidden", "label_values_not_grounded", "no_new_grounded_observation", "label_not_strengthened", "submit_payload_invalid", "draft_validation_failed", "reject_too_easy", "reject_too_hard")


@add("SELECT event_id, CASE event_id % 23 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_FAULTS)).replace("question_body_required", "question_entity_block_required") + " END AS code FROM events")
def draft_codes(spark: SparkSession, root: str) -> DataFrame:
    """Drafts made from events, each with the fault that its number asks for. A blank body, its white space taken off, leaves no block that is followed by one."""
    n = F.col("event_id") % 23
    odd = lambda code, wrong, right: F.when(n == _FAULTS.index(code), wrong).otherwise(right)
    entity = F.format_string('{"user": %d}', "user_id")
    good = F.concat(F.lit("<entity>\n"), entity, F.lit("\n</entity>\n\nWhat did it do?"))
    question = odd("question_entity_block_required", F.lit("What did it do?"), good)
    question = odd("question_entity_block_invalid_json", F.replace(good, F.lit("{"), F.lit("(")), question)
    question = odd("question_entity_block_mismatch", F.replace(good, F.lit(': '), F.lit(": 1")), question)
    question = odd("question_body_required", F.replace(good, F.lit("What did it do?"), F.lit(" \n ")), question)
    question = odd("question_raw_identifier_leak", F.concat(good, F.lit(" See order_ids.")), question)
    question = odd("question_entity_placeholder_forbidden", F.concat(good, F.lit(" <b>It</b> is &lt;Entity&gt; {x}.")), question)
    label = F.format_string('[{"kind": "%s", "k": %s}]', "event_type", F.get_json_object("props", "$.k"))
    label = odd("canonical_answer_json_invalid", F.lit("[]"), label)
    label = odd("label_blank_string_forbidden", F.lit('[{"kind": " "}]'), label)
    label = odd("label_values_not_grounded", F.lit('[{"kind": "unseen"}]'), label)
    label = odd("draft_validation_failed", F.format_string('[{"kind": "%s"}, {"k": 1}]', "event_type"), label)
    entity_given = odd("anchor_entity_scalar_map_required", F.lit('{"a": [1]}'), odd("anchor_entity_required", F.lit("{}"), entity))
    fields = [odd("topic_required", F.lit(" "), F.col("event_type")).alias("topic"), F.try_parse_json(label).alias("label"), entity_given.alias("entity"), odd("question_required", F.lit(None), question).alias("question"), odd("submit_payload_invalid", F.lit("x"), F.lit(None)).alias("note")]
    rows = read_table(spark, root, "events").select(
        "event_id",
        F.to_json(F.struct(*fields)).alias("payload"),
        F.format_string('{"rows": [["%s "]]}', F.upper("event_type")).alias("observed"),
        odd("no_new_grounded_observation", F.lit(0), F.lit(2)).alias("new_calls"),
        odd("label_not_strengthened", label, F.lit("[1]")).alias("refused_label"),
        F.when(n == _FAULTS.index("reject_too_easy"), "too_easy").when(n == _FAULTS.index("reject_too_hard"), "too_hard").otherwise("accept").alias("verdict"),
    )
    return drafts.checked_payloads(rows, "payload", "observed", "new_calls", "refused_label", "verdict").select("event_id", "code")


@add(f"SELECT event_id, question LIKE '<entity>%' AS has_entity, CASE WHEN question LIKE '<entity>%' THEN split_part(question, chr(10), 2) END AS entity_json, CASE WHEN question LIKE '<entity>%' THEN split_part(question, chr(10), 5) END AS body FROM ({_DRAFT})")
def entity_prompts(spark: SparkSession, root: str) -> DataFrame:
    return drafts.split_prompts(_drafts(spark, root), "question").select("event_id", "has_entity", "entity_json", "body")


@add("SELECT event_id, event_type, CASE WHEN user_id % 3 = 0 THEN 'known ' || event_id ELSE 'topic: ' || event_type || chr(10) || 'constraints: ' || props END AS semantic_text FROM events WHERE event_type = 'click' ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 30")
def dedup_candidates(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "events").selectExpr("*", "CAST(NULL AS STRING) AS question", "IF(user_id % 3 = 0, concat('known ', event_id), ' ') AS semantic")
    return reg.candidates(rows, 30, "ts", "event_id", "event_type", "question", "props", "semantic", {"event_type": "click"})


@add("SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'signup') AS task_count FROM events WHERE event_type = 'signup' ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 5")
def registry_recent(spark: SparkSession, root: str) -> DataFrame:
    return reg.recent(read_table(spark, root, "events"), ["event_id", "event_type"], 5, "ts", "event_id", {"event_type": "signup"})


@add("SELECT table_name, column_name, printf('- %s.%s: low(<%.2f) mid(%.2f-%.2f) high(>%.2f)', table_name, column_name, low, low, high, high) AS line FROM (" + SQL["numeric_bands"] + ") UNION ALL SELECT table_name, column_name, '- ' || table_name || '.' || column_name || ': ' || count(*) || ' categories [' || string_agg(value || '(' || frequency || ')', ', ' ORDER BY frequency DESC, value) || ']' FROM (" + SQL["categorical_topk"] + ") GROUP BY 1, 2")
def profile_lines(spark: SparkSession, root: str) -> DataFrame:
    f = frames(spark, root)
    return explore.profile_lines(explore.numeric_bands(star_catalog(), f, ["customer", "part"]), explore.categorical_values(star_catalog(), f, ["orders", "customer"]))


@add("SELECT event_id, 'topic: ' || event_type || chr(10) || 'question: ' || chr(10) || 'answer: ' || props || chr(10) || 'schema: ' || chr(10) || 'constraints: ' || chr(10) || 'payload: p' AS semantic_text FROM events")
def semantic_texts(spark: SparkSession, root: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return read_table(spark, root, "events").select("event_id", dedup.semantic_text(F.col("event_type"), none, F.col("props"), none, none, F.lit("p")).alias("semantic_text"))


@add("SELECT event_id, lower(event_type) AS value FROM events WHERE event_id % 3 = 0 AND event_type NOT IN ('click', 'view')")
def ungrounded_values(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "events").selectExpr("event_id", "concat('{\"a\": [\"', event_type, '\", 3]}') AS answer", "IF(event_id % 3 = 0, '[\"Click \", \"view\"]', concat('\"', event_type, '\"')) AS observed")
    return json_leaves.ungrounded(rows, rows, key="event_id")


#: Each user's events as tool calls: a call asks for the tens of its k and shows its kind and what comes next; known numbers are bits of a mask.
_CALLS = "c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, k // 10 AS asks, (k * 7 % 100) // 10 AS next, event_type || '-' || k % 10 AS kind, value > 20 AS said FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"


@add(f"WITH RECURSIVE {_CALLS}, f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(1 << (user_id % 10) AS BIGINT) AS mask, CAST(NULL AS VARCHAR) AS kind, false AS ok FROM c UNION ALL SELECT c.user_id, c.r, CASE WHEN (mask >> asks) & 1 = 1 THEN mask | (1 << next) ELSE mask END, c.kind, (mask >> asks) & 1 = 1 FROM f JOIN c ON c.user_id = f.user_id AND c.r = f.r + 1) SELECT DISTINCT user_id, kind AS value FROM c WHERE said AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = c.user_id AND f.kind = c.kind AND f.ok)")
def disconnected_strings(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.concat("event_type", F.lit("-"), (k % 10).cast("string"))
    events = read_table(spark, root, "events")
    calls = events.select("user_id", "event_id", F.to_json(F.struct(F.floor(k / 10).alias("k"))).alias("params"), F.to_json(F.struct(F.array(F.struct(kind.alias("kind"))).alias("rows"), F.floor(k * 7 % 100 / 10).alias("next"))).alias("result"))
    anchor = events.select("user_id", F.to_json(F.struct((F.col("user_id") % 10).alias("start"))).alias("anchor")).distinct()
    answers = events.where("value > 20").groupBy("user_id").agg(F.to_json(F.collect_set(kind)).alias("answer"))  # of 50 kinds
    return anchors.disconnected_strings(answers, calls, anchor, "user_id", "event_id", "params", "result", "anchor", "answer")


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Counts and revenue of returned and accepted items by market segment, along line items, orders and customers."""
    return dsl.query(star_catalog(), frames(spark, root), FLAGSHIP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
