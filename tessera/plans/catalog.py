"""Declared tables, keys and foreign-key edges; edge labels; JSON round trip."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Table:
    """A table. key: its key columns, empty if it has none. visibility: by column, where it is not user_visible."""

    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...] = ()
    visibility: tuple[tuple[str, str], ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c for c, _ in self.columns)

    def type_of(self, column: str) -> str:
        for name, kind in self.columns:
            if name == column:
                return kind
        raise KeyError(f"{self.name} has no column {column!r}; it has {', '.join(self.names)}")


@dataclass(frozen=True)
class Edge:
    """A single-column foreign key: source.column refers to target.target_column."""

    source: str
    column: str
    target: str
    target_column: str
    nullable: bool = False
    unique: bool = False

    @property
    def forward(self) -> str:
        return f"{self.source}.{self.column}->{self.target}"

    @property
    def reverse(self) -> str:
        return f"{self.target}<-{self.source}.{self.column}"


@dataclass(frozen=True)
class Hop:
    """An edge walked in one direction: rows of `origin` with origin_column equal to dest_column of `dest`."""

    label: str
    origin: str
    origin_column: str
    dest: str
    dest_column: str
    is_forward: bool
    edge: Edge


@dataclass(frozen=True)
class Catalog:
    tables: tuple[Table, ...]
    edges: tuple[Edge, ...] = ()
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        for t in self.tables:
            if t.name in self._by_name:
                raise ValueError(f"two tables are named {t.name}")
            self._by_name[t.name] = t
        for e in self.edges:
            self.table(e.source).type_of(e.column)
            self.table(e.target).type_of(e.target_column)

    def table(self, name: str) -> Table:
        if name not in self._by_name:
            raise KeyError(f"unknown table {name!r}")
        return self._by_name[name]

    def hops(self, origin: str) -> list[Hop]:
        """All edges at a table: first those it holds, then those that refer to it."""
        self.table(origin)
        out = [Hop(e.forward, e.source, e.column, e.target, e.target_column, True, e) for e in self.edges if e.source == origin]
        return out + [Hop(e.reverse, e.target, e.target_column, e.source, e.column, False, e) for e in self.edges if e.target == origin]

    def hop(self, origin: str, label: str) -> Hop:
        for h in self.hops(origin):
            if h.label == label:
                return h
        raise KeyError(f"no edge {label!r} starts at {origin}")

    def nearby(self, root: str | None, depth: int) -> list[str]:
        """Tables within `depth` edges of the root in either direction, nearest first; all without a root."""
        if root is None:
            return [t.name for t in self.tables]
        self.table(root)
        seen, queue = {root: 0}, deque([root])
        while queue:
            at = queue.popleft()
            if seen[at] < depth:
                for h in self.hops(at):
                    if h.dest not in seen:
                        seen[h.dest] = seen[at] + 1
                        queue.append(h.dest)
        return list(seen)

    def paths(self, max_hops: int) -> list[tuple[Edge, ...]]:
        """Simple paths over forward edges, of up to max_hops. Parallel edges give paths of their own."""
        out: list[tuple[Edge, ...]] = []

        def walk(at: str, seen: frozenset[str], path: tuple[Edge, ...]) -> None:
            for e in self.edges:
                if e.source == at and e.target not in seen and len(path) < max_hops:
                    out.append((*path, e))
                    walk(e.target, seen | {e.target}, (*path, e))

        for t in self.tables:
            walk(t.name, frozenset((t.name,)), ())
        return out

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables], "edges": [asdict(e) for e in self.edges]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        d = json.loads(text)
        pairs = lambda x: tuple((a, b) for a, b in x)
        tables = tuple(Table(t["name"], pairs(t["columns"]), tuple(t["key"]), pairs(t["visibility"])) for t in d["tables"])
        return cls(tables, tuple(Edge(**e) for e in d["edges"]))


def _table(name: str, columns: str, *key: str) -> Table:
    return Table(name, tuple(tuple(c.split(":")) for c in columns.split()), key)  # type: ignore[misc]


def star_catalog() -> Catalog:
    """The TPC-H-like tables with the keys and references that hold in them; lineitem has no key."""
    return Catalog(
        (
            _table("region", "r_regionkey:int r_name:string", "r_regionkey"),
            _table("nation", "n_nationkey:int n_name:string n_regionkey:int", "n_nationkey"),
            _table("customer", "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string", "c_custkey"),
            _table("supplier", "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double", "s_suppkey"),
            _table("part", "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double", "p_partkey"),
            _table("orders", "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string", "o_orderkey"),
            _table("lineitem", "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz"),
            _table("events", "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string", "event_id"),
            _table("documents", "doc_id:bigint text:string lang:string source:string n_chars:bigint", "doc_id"),
            _table("labels", "doc_id:bigint quality:int toxic:int", "doc_id"),
            _table("conversations", "conv_id:bigint turn:bigint role:string text:string", "conv_id", "turn"),
        ),
        (
            Edge("nation", "n_regionkey", "region", "r_regionkey"),
            Edge("customer", "c_nationkey", "nation", "n_nationkey"),
            Edge("supplier", "s_nationkey", "nation", "n_nationkey"),
            Edge("orders", "o_custkey", "customer", "c_custkey"),
            Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
            Edge("lineitem", "l_partkey", "part", "p_partkey"),
            Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            Edge("labels", "doc_id", "documents", "doc_id", unique=True),
        ),
    )
