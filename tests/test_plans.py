import pytest

from tessera.plans.catalog import Catalog, Edge, Table, star_catalog
from tessera.plans.cursor import Order, Store, Via, Where, plan_id, split_order


def test_labels_resolve_from_their_origin_only():
    c = star_catalog()
    assert c.hop("orders", "orders.o_custkey->customer").dest == "customer"
    back = c.hop("customer", "customer<-orders.o_custkey")
    assert (back.dest, back.origin_column, back.dest_column, back.is_forward) == ("orders", "c_custkey", "o_custkey", False)
    with pytest.raises(KeyError):
        c.hop("customer", "orders.o_custkey->customer")
    assert [h.is_forward for h in c.hops("nation")] == [True, False, False]


def test_json_round_trip():
    c = star_catalog()
    assert Catalog.from_json(c.to_json()) == c


def test_bad_edges_and_names_are_refused():
    t = Table("a", (("x", "int"),), ("x",))
    with pytest.raises(KeyError):
        Catalog((t,), (Edge("a", "y", "a", "x"),))
    with pytest.raises(ValueError):
        Catalog((t, t))


def test_nearby_and_paths():
    c = star_catalog()
    assert set(c.nearby("region", 1)) == {"region", "nation"}
    assert {p[-1].target for p in c.paths(1) if p[0].source == "lineitem"} == {"orders", "part", "supplier"}
    assert max(len(p) for p in c.paths(4)) == 4


def test_plan_ids():
    a, b = Where("orders", "o_orderkey", "eq", 1), Where("orders", "o_orderkey", "eq", 2)
    assert plan_id(a) == plan_id(Where("orders", "o_orderkey", "eq", 1)) != plan_id(b)
    assert plan_id(a).startswith("c_") and len(plan_id(a)) == 18
    assert plan_id(Via(a, "e", "t")) != plan_id(Via(b, "e", "t"))


def test_store_holds_its_capacity():
    s = Store(2)
    a = s.intern(Where("t", "c", "eq", 1))
    assert s.intern(Where("t", "c", "eq", 1)) == a and len(s) == 1
    s.intern(Where("t", "c", "eq", 2))
    with pytest.raises(RuntimeError):
        s.intern(Where("t", "c", "eq", 3))
    with pytest.raises(KeyError):
        s.plan("c_0")


def test_outer_order_is_first():
    base = Where("t", "c", "eq", 1)
    assert split_order(Order(Order(base, "x", False, "t"), "y", True, "t")) == (base, [("y", True), ("x", False)])
