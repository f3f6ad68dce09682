"""Compiled contracts against their plain form in Python, on values that fit and values that nearly do."""

import json
import random

from pyspark.sql import functions as F

from tessera.functions import canonical as can
from tessera.functions import contracts, json_leaves

INT, NUM, TEXT = can.Field("int"), can.Field("float"), can.Field("string")
LINE = can.Field("object", "lines", fields=(can.Field("string", "sku"), can.Field("int", "n"), can.Field("float", "price", nullable=True)))
CONTRACTS = [
    INT,
    NUM,
    TEXT,
    can.Field("bool", nullable=True),
    can.Field("date"),
    can.Field("datetime"),
    can.Field("enum", values=("a", "b", 3)),
    can.Field("list", items=TEXT),
    can.Field("list", items=INT, unique=True),
    can.Field("list", items=NUM, ordered=True),
    can.Field("list", items=can.Field("list", items=INT)),
    can.Field("list", items=LINE, sort_key=("n", "sku")),
    can.Field("object", fields=(can.Field("date", "on"), can.Field("list", "tags", items=TEXT, unique=True), can.Field("object", "who it's", fields=(can.Field("int", "id"), can.Field("string", "name", nullable=True))))),
]
SCALARS = ["1", "0", "-3", "10", "2", "1.0", "1.5", "1e2", "true", "false", "null", '"a"', '"b"', '" a"', '"A\\"q\\\\"', '"\\u00e9\\n"', '""', '"2024-02-29"', '"2023-02-29"', '"20240229"', '" 2024-02-29T10:05:07Z "', '"2024-02-29 10:05"', '"2024-02-29T10:05:07.123456+02:00"', '"2024-02-29T25:00"', '"2024-0229"', '"x"']


def value(rng, depth=0):
    r = rng.random()
    if depth > 2 or r < 0.4:
        return rng.choice(SCALARS)
    if r < 0.7:
        return "[" + ", ".join(value(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    keys = rng.sample(["sku", "n", "price", "on", "tags", "who it's", "id", "name", "odd"], rng.randrange(4))
    return "{" + ", ".join(f"{json.dumps(k)} : {value(rng, depth + 1)}" for k in keys) + "}"


def fitting(rng, c):
    pick = {"int": ["1", "2", "10", "-3"], "float": ["1", "1.0", "2.50", "1e2", "100.0"], "string": ['"b"', '"a"', '"é"', '"\\u00e9"'], "bool": ["true", "false"], "date": ['"2024-02-29"', '"20240229"', '"2024-02-29T10:05:07Z"'], "datetime": ['"2024-02-29T10:05:07Z"', '"2024-02-29 10:05:07+00:00"', '"2024-02-29"', '"2024-02-29T10:05:07.5"'], "enum": ['"a"', '"b"', "3"]}
    if c.nullable and rng.random() < 0.3:
        return "null"
    if c.kind == "object":
        fields = [f for f in c.fields if not (f.nullable and rng.random() < 0.3)]
        rng.shuffle(fields)
        return "{" + ",".join(f"{json.dumps(f.name)}: {fitting(rng, f)}" for f in fields) + "}"
    if c.kind == "list":
        return "[" + ",".join(fitting(rng, c.items) for _ in range(rng.randrange(4))) + "]"
    return rng.choice(pick[c.kind])


def plain(text, contract):
    try:
        return can.dumps(can.canonicalize(json.loads(text), contract))
    except ValueError:
        return None


def test_compiled_contracts(spark):
    rng = random.Random(7)
    for contract in CONTRACTS:
        texts = [*SCALARS, "[1,", "nope", "", *(value(rng) for _ in range(60)), *(fitting(rng, contract) for _ in range(80))]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", contracts.canonical_json(F.col("t"), contract).alias("c"))
        got = {r.i: r.c for r in df.collect()}
        want = [plain(t, contract) for t in texts]
        assert [(t, got[i]) for i, t in enumerate(texts) if (got[i] is None) != (want[i] is None)] == []
        forms = {}
        for i, w in enumerate(want):
            if w is not None:
                forms.setdefault(w, set()).add(got[i])
        # equal in one form if and only if equal in the other
        assert all(len(x) == 1 for x in forms.values())
        assert len({next(iter(x)) for x in forms.values()}) == len(forms)


def test_rewards_of_all_kinds(spark):
    c = can.Field("object", fields=(can.Field("list", "a", items=INT),))
    rows = [('{"a":[2,1]}', '{"a":[1,2]}', "matched"), ('{"a":[1]}', '{"a":[1,2]}', "em_mismatch"), ('{"b":1}', '{"a":[]}', "schema_mismatch"), ("{", '{"a":[]}', "decode_failed"), (None, '{"a":[]}', "decode_failed"), ('{"a":[]}', '{"a":1}', "schema_mismatch")]
    out = contracts.rewards(spark.createDataFrame([r[:2] for r in rows], "s string, e string"), "s", "e", c)
    assert [(r.status, r.reward) for r in out.collect()] == [(r[2], float(r[2] == "matched")) for r in rows]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_leaves_and_paths(spark):
    texts = ['{"a": ["X ", 3, {"b": "y\\"z"}], "k": "v"}', '["\\\\", "a:b", "{\\"q\\":1}"]', '"One"', "3", None, "[1", '{"d": "2024-01-01", "t": "2024-01-01T00:00:00Z", "l": [], "m": [{"x": null, "y": 1.5}, {"z": true}], "s": "2024-13-01"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [sorted(r[0]) for r in df.select(json_leaves.string_leaves(F.col("t"))).collect()]

    def read(t):
        try:
            return sorted(can.leaves(json.loads(t))) if t else []
        except ValueError:
            return []

    assert got == [read(t) for t in texts]
    paths = {}
    for t in texts:
        try:
            for p in can.flatten(can.infer(json.loads(t))) if t else []:
                paths[p] = paths.get(p, 0) + 1
        except ValueError:
            pass
    assert {r.path: r.n for r in contracts.inferred_paths(df, "t").collect()} == paths
    flat = spark.createDataFrame([('{"a": 1.0, "b": [1], "c": " Q", "d": null, "e": true, "f": {"g": 2}}',), ("[1]",), ("x",)], "t string")
    assert [sorted(r[0]) for r in flat.select(json_leaves.flat_object(F.col("t"))).collect()] == [["n:1", "n:1", "null", "s:q"], [], []]
