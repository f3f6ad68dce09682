import pytest
from pyspark.sql import functions as F

from tessera.operators.calculus import Calculus, ordered
from tessera.operators.dsl import Query, query
from tessera.operators.tools import NAMES, Toolbox
from tessera.plans.catalog import Catalog, Edge, Table

CATALOG = Catalog(
    (
        Table("film", (("film_id", "int"), ("title", "string")), ("film_id",)),
        Table("copy", (("copy_id", "int"), ("film_id", "int"), ("price", "double")), ("copy_id",)),
        Table("tag", (("film_id", "int"), ("word", "string"), ("weight", "int")), ("film_id", "word")),
        Table("loan", (("copy_id", "int"), ("day", "int"))),
    ),
    (Edge("copy", "film_id", "film", "film_id", nullable=True), Edge("loan", "copy_id", "copy", "copy_id"), Edge("tag", "film_id", "film", "film_id")),
)


@pytest.fixture(scope="module")
def frames(spark):
    made = {
        "film": spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, None), (4, "x_y")], "film_id int, title string"),
        "copy": spark.createDataFrame([(10, 1, 1.5), (11, 1, None), (12, 2, 2.5), (13, None, 9.0)], "copy_id int, film_id int, price double"),
        "tag": spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, "a", 7)], "film_id int, word string, weight int"),
        "loan": spark.createDataFrame([(10, 1), (10, 2), (12, 1), (10, 3)], "copy_id int, day int"),
    }
    return made.__getitem__


@pytest.fixture
def calc(frames):
    return Calculus(CATALOG, frames)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_predicates(calc):
    count = lambda *a: rows(calc.count(calc.rows_where(*a)))[0][0]
    assert count("film", "title", "like", "ab") == 2
    assert count("film", "title", "eq", None) == 0
    assert count("film", "film_id", "in", ["1", 3]) == 2
    assert count("copy", "price", "gt", "2") == 2 and count("copy", "price", "lte", 2.5) == 2
    assert count("copy", "price", "lt", 1) == 0 and count("copy", "price", "gte", 1.5) == 3
    for bad in (("film", "title", "ne", 1), ("film", "film_id", "in", []), ("film", "title", "like", 1), ("film", "film_id", "eq", "one"), ("film", "film_id", "eq", [1])):
        with pytest.raises((ValueError, TypeError)):
            calc.rows_where(*bad)
    with pytest.raises(KeyError):
        calc.rows_where("film", "nope", "eq", 1)


def test_hops_keep_multiplicity_and_drop_null_keys(calc):
    loans = calc.rows_where("loan", "day", "gte", 1)
    copies = calc.rows_via(loans, "loan.copy_id->copy")
    films = calc.rows_via(copies, "copy.film_id->film")
    assert rows(calc.count(films)) == [(4,)]
    assert rows(calc.take(films, 5)) == [(1,), (2,)]
    every = calc.rows_via(calc.rows_where("copy", "copy_id", "gte", 0), "copy.film_id->film")
    assert rows(calc.count(every)) == [(3,)]
    assert rows(calc.group_top(copies, "film_id", "count", 2)) == [(1, 3), (2, 1)]


def test_orders_and_ties(calc):
    c = calc.rows_where("copy", "copy_id", "gte", 0)
    assert rows(calc.take(calc.order_by(c, "price", "desc"), 4)) == [(11,), (13,), (12,), (10,)]
    assert rows(calc.take(calc.order_by(c, "price"), 4)) == [(10,), (12,), (13,), (11,)]
    back = calc.rows_via(calc.rows_where("film", "film_id", "lte", 2), "film<-copy.film_id")
    assert rows(calc.take(calc.order_by(back, "price", "desc"), 2)) == [(11,), (12,)]
    assert rows(calc.count(calc.order_by(back, "price"))) == [(3,)]
    for n in (1, 6, True, 2.0):
        with pytest.raises(ValueError):
            calc.take(c, n)
    with pytest.raises(KeyError):
        calc.order_by(c, "nope")


def test_intersect(calc):
    a = calc.rows_via(calc.rows_where("loan", "day", "lte", 2), "loan.copy_id->copy")
    b = calc.rows_where("copy", "price", "lt", 2)
    assert rows(calc.take(calc.intersect(a, b), 5)) == [(10,)]
    with pytest.raises(ValueError):
        calc.intersect(a, calc.rows_where("film", "film_id", "eq", 1))
    tags = calc.rows_where("tag", "word", "eq", "a")
    assert rows(calc.take(calc.intersect(tags, calc.rows_where("tag", "film_id", "eq", 1)), 2)) == [(1, "a")]
    with pytest.raises(ValueError):
        calc.intersect(calc.rows_where("loan", "day", "eq", 1), calc.rows_where("loan", "day", "eq", 2))


def test_aggregates(calc):
    c = calc.rows_where("copy", "copy_id", "gte", 0)
    assert rows(calc.aggregate(c, "sum", "price")) == [(13.0,)]
    assert rows(calc.aggregate(c, "avg", "price")) == [(pytest.approx(13 / 3),)]
    assert rows(calc.aggregate(calc.rows_where("copy", "copy_id", "lt", 0), "max", "price")) == [(None,)]
    assert rows(calc.group_top(c, "film_id", "max", 3, "price")) == [(None, 9.0), (2, 2.5), (1, 1.5)]
    with pytest.raises(ValueError):
        calc.group_top(c, "film_id", "count", 2, "price")
    with pytest.raises(ValueError):
        calc.aggregate(c, "median", "price")


def test_read(calc):
    assert calc.read_one("tag", [1, "b"], ["weight", "word"]) == {"weight": None, "word": "b"}
    with pytest.raises(LookupError):
        calc.read_one("film", 99, ["title"])
    for bad in (("tag", 1, ["word"]), ("film", 1, []), ("loan", 1, ["day"])):
        with pytest.raises(ValueError):
            calc.read(*bad)


def test_one_scan_for_each_table(calc):
    films = calc.rows_via(calc.rows_via(calc.rows_where("loan", "day", "eq", 1), "loan.copy_id->copy"), "copy.film_id->film")
    assert calc.count(films)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3


def test_null_order(spark):
    df = spark.createDataFrame([(1, None, "Ab"), (2, 5, "aB"), (3, 7, None)], "id int, v int, t string")
    assert [r.id for r in df.orderBy(ordered("v", False)).collect()] == [2, 3, 1]
    assert [r.id for r in df.orderBy(ordered(F.col("v"), True)).collect()] == [1, 3, 2]


def test_dsl(frames):
    spec = {"from": "copy", "filter": [{"column": "price", "op": "gt", "value": "1"}], "join": ["copy.film_id->film"], "group_by": ["title"], "aggregate": [{"fn": "count", "alias": "n"}, {"fn": "sum", "column": "price", "alias": "total"}], "sort": [{"column": "n", "direction": "desc"}, {"column": "title"}]}
    assert rows(query(CATALOG, frames, spec)) == [("Ab", 1, 1.5), ("aB", 1, 2.5)]
    assert query(CATALOG, frames, {"from": "copy", "join": ["copy.film_id->film"]}).columns == ["film_id", "title"]
    assert rows(query(CATALOG, frames, {"from": "loan", "join": ["loan.copy_id->copy"], "select": ["copy_id", "day"], "sort": [{"column": "day"}, {"column": "copy_id"}], "limit": 2})) == [(10, 1), (12, 1)]


@pytest.mark.parametrize(
    "spec",
    [
        {},
        {"from": "nope"},
        {"from": "film", "what": 1},
        {"from": "film", "join": ["copy.film_id->film"]},
        {"from": "film", "select": ["title"], "aggregate": [{"fn": "count", "alias": "n"}]},
        {"from": "film", "group_by": ["title"]},
        {"from": "film", "aggregate": [{"fn": "sum", "alias": "n"}]},
        {"from": "film", "aggregate": [{"fn": "count", "alias": "n"}, {"fn": "count", "alias": "n"}]},
        {"from": "film", "aggregate": [{"fn": "mode", "alias": "n"}]},
        {"from": "film", "select": ["price"]},
        {"from": "film", "limit": 0},
        {"from": "film", "limit": True},
        {"from": "copy", "group_by": ["film_id"], "aggregate": [{"fn": "count", "alias": "n"}], "sort": [{"column": "price"}]},
        {"from": "film", "sort": [{"column": "title", "direction": "up"}]},
    ],
)
def test_dsl_refuses(spec):
    with pytest.raises((ValueError, KeyError, TypeError)):
        Query(CATALOG, spec)


def test_tools(frames):
    import json

    log = []
    box = Toolbox(CATALOG, frames, lambda *a: log.append(a))
    cursor = json.loads(box.call("rows_where", '{"table": "film", "column": "film_id", "op": "lte", "value": 2}'))["cursor"]
    assert json.loads(box.call("take", {"cursor": cursor, "n": 5})) == {"rows": [1, 2]}
    assert json.loads(box.call("count", "{"))["error_type"] == "JSONDecodeError"
    assert json.loads(box.call("take", {"cursor": "c_x", "n": 2}))["error_type"] == "KeyError"
    found = json.loads(box.call("neighborhood", {"table": "film", "row_id": 1}))
    assert {e["label"]: (e["status"], e["total"]) for e in found["edges"]} == {"film<-copy.film_id": ("ok", 2), "film<-tag.film_id": ("unsupported", None)}
    assert json.loads(box.call("query", {"spec": {"from": "film", "aggregate": [{"fn": "count", "alias": "n"}]}})) == {"columns": ["n"], "rows": [{"n": 4}], "row_count": 1, "truncated": False}
    assert set(box.schemas()) == set(NAMES) and len(log) == 6
