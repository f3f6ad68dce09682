import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical as can
from tessera.functions import contracts, json_leaves, privacy
from tessera.functions.values import coerce
from tessera.operators import calibration as cal
from tessera.operators import dedup, explore
from tessera.operators import registry_ops as reg
from tessera.plans.catalog import Catalog, Table
from tessera.sources import files
from tessera.streaming import flows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_coerce():
    assert coerce("7", "bigint") == 7 and coerce(["1", 2], "int") == [1, 2] and coerce("yes", "boolean") is True
    assert coerce("2020-01-02", "timestamp_ntz") == datetime(2020, 1, 2)
    for bad in (("x", "int"), ("maybe", "boolean"), ("1.2.3", "decimal(9,2)")):
        with pytest.raises(ValueError):
            coerce(*bad)


def test_profile_of_no_rows_is_zero(spark):
    c = Catalog((Table("t", (("id", "int"), ("b", "binary")), ("id",)),))
    empty = spark.createDataFrame([], "id int, b binary")
    assert rows(explore.profile_table(c, lambda _: empty, "t")) == [("id", 0, 0, 0), ("b", 0, 0, 0)]
    assert rows(explore.profile_column(c, lambda _: empty, "t", "b")) == [(0, 0, 0, None, None)]


def test_visibility_and_redaction(spark):
    assert privacy.visibility("users", "password_hash") == privacy.BLOCKED
    assert privacy.visibility("users", "email") == privacy.INTERNAL
    assert privacy.visibility("users", "name") == privacy.VISIBLE
    assert privacy.visibility("users", "email", {"users.email": privacy.VISIBLE}) == privacy.VISIBLE
    # the default holds, but for safe names where it is blocked
    assert privacy.visibility("staff", "notes") == privacy.visibility("team", "notes", sensitive_tables=["team"]) == privacy.visibility("staff", "name") == privacy.VISIBLE
    assert privacy.visibility("team", "name", default=privacy.BLOCKED) == privacy.INTERNAL and privacy.visibility("team", "notes", default=privacy.BLOCKED) == privacy.visibility("staff", "name", default=privacy.BLOCKED) == privacy.visibility("team", "name", default=privacy.BLOCKED, sensitive_tables=["team"]) == privacy.BLOCKED
    assert privacy.visibility("team", "name", default=privacy.INTERNAL) == privacy.INTERNAL
    assert {privacy.visibility("t", c) for c in ("passport", "tax_id", "iban", "bank_account", "routing_number", "social_security", "user_pin")} == {privacy.BLOCKED}
    assert {privacy.visibility("t", c) for c in ("first_name", "last_name", "birthday", "telephone", "city", "country")} == {privacy.INTERNAL}
    assert privacy.visibility("t", "pinned") == privacy.visibility("t", "capacity") == privacy.VISIBLE and privacy.visibility("t", "iban", {"public.t.iban": privacy.INTERNAL}) == privacy.INTERNAL
    assert privacy.visibility("staff", "name", sensitive_tables=["staff"], safe_columns=["name"]) == privacy.VISIBLE
    df = spark.createDataFrame([(1, "a", None, "z")], "id int, e string, n string, u string")
    assert rows(privacy.redact(df, {"id": privacy.VISIBLE, "e": privacy.INTERNAL, "n": privacy.INTERNAL})) == [(1, "[INTERNAL]", None, "[REDACTED]")]


LIST = can.Field("list", items=can.Field("object", fields=(can.Field("int", "day"), can.Field("string", "note", nullable=True))), sort_key=("day",), unique=True)


@pytest.mark.parametrize(
    ("value", "contract", "out"),
    [
        ([{"day": 2, "note": None}, {"day": 1}, {"day": 2}], LIST, '[{"day":1,"note":null},{"day":2,"note":null}]'),
        (["b", "a"], can.Field("list", items=can.Field("string")), '["a","b"]'),
        ([2, 1], can.Field("list", items=can.Field("int"), ordered=True), "[2,1]"),
        (1, can.Field("float"), "1.0"),
        ("2020-01-01T00:00:00Z", can.Field("datetime"), '"2020-01-01T00:00:00+00:00"'),
        (" 2020-01-01 ", can.Field("date"), '"2020-01-01"'),
        ("x", can.Field("enum", values=("x", "y")), '"x"'),
        ("é", can.Field("string"), '"é"'),
        (None, can.Field("int", nullable=True), "null"),
    ],
)
def test_canonical(value, contract, out):
    assert can.dumps(can.canonicalize(value, contract)) == out


@pytest.mark.parametrize(("value", "contract"), [(True, can.Field("int")), (1, can.Field("bool")), (1.0, can.Field("int")), (None, can.Field("string")), ({"day": 1, "x": 2}, LIST.items), ({}, LIST.items), ("z", can.Field("enum", values=("x",))), ("2020-13-01", can.Field("date")), ({}, LIST), (float("inf"), can.Field("float"))])
def test_mismatch(value, contract):
    with pytest.raises(can.Mismatch):
        can.canonicalize(value, contract)


def test_contracts_are_checked():
    obj = can.Field("object", fields=(can.Field("int", "a", nullable=True),))
    for bad in ({"kind": "enum"}, {"kind": "list"}, {"kind": "object"}, {"kind": "list", "items": obj}, {"kind": "list", "items": obj, "sort_key": ("a",)}, {"kind": "int", "ordered": True}, {"kind": "what"}):
        with pytest.raises(ValueError):
            can.Field(**bad)


def test_rewards(spark):
    df = spark.createDataFrame([('[{"day": 1}]', "[]"), ("[", "[]"), ("[1]", "[]"), ('[{"day":2},{"day":1}]', '[{"day":1},{"day":2}]'), (None, "[]")], "got string, want string")
    assert [r.status for r in contracts.rewards(df, "got", "want", LIST).collect()] == ["em_mismatch", "decode_failed", "schema_mismatch", "matched", "decode_failed"]


def test_inference():
    c = can.infer([{"day": 1, "city": "x", "at": "2020-01-01", "n": None}])
    assert can.flatten(c) == ["[].day:int", "[].city:string", "[].at:date", "[].n:string"] and c.sort_key == ("day", "city", "at")
    assert can.infer([]).items.kind == "string" and can.infer(None).nullable
    assert can.slot_change([{"a": 1}], [{"b": 1}, {"c": 2}]) == {"added": ["b", "c"], "removed": ["a"], "delta": 1, "changed": True}


def test_ungrounded(spark):
    a = spark.createDataFrame([(1, json.dumps({"x": ["Oslo ", "Rome"], "n": 3}))], "task_id int, answer string")
    b = spark.createDataFrame([(1, json.dumps("oslo")), (2, json.dumps("rome"))], "task_id int, observed string")
    assert rows(json_leaves.ungrounded(a, b)) == [(1, "rome")]


def test_intervals():
    assert [round(x, 3) for x in cal.clopper_pearson(2, 3, 0.1)] == [0.135, 0.983]
    assert [round(x, 3) for x in cal.clopper_pearson(1, 3, 0.1)] == [0.017, 0.865]
    assert cal.clopper_pearson(0, 5, 0.1)[0] == 0 and cal.clopper_pearson(5, 5, 0.1)[1] == 1 and cal.clopper_pearson(0, 0, 0.1) == (0, 1)


def test_early_stop(spark):
    df = spark.createDataFrame([(6, 5, 0), (6, 5, 5), (4, 4, 2), (6, 3, 1)], "total int, n int, passes int")
    assert [r[0] for r in df.select(cal.possible(F.col("total"), F.col("n"), F.col("passes"), 0.2, 0.8)).collect()] == ["too_hard", "too_easy", "accept", "continue"]


def test_registry(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y"), (None, 1, "z")], "k string, at int, v string")
    assert sorted(rows(reg.latest_by_key(df, ["k"], ["at"])), key=str) == sorted([("a", 3, None), ("b", 2, "y"), (None, 1, "z")], key=str)
    assert reg.listing(df, 0, "at", "k").count() == 0 and rows(reg.listing(df, 1, "at", "k")) == [("a", 3, None)]
    assert rows(dedup.exact_dedup(df, ["v"], ["at", "k"]).select("k").orderBy("k")) == [(None,), ("a",), ("a",), ("b",)]
    counts = reg.coverage(df, ["k"])
    assert rows(reg.deficits(spark.createDataFrame([("a",), ("c",)], "k string"), counts, ["k"], 2)) == [("c", 0, 2), ("a", 2, 0)]


def test_export_fails_on_an_old_target(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "db string, id int")
    reg.export(df, str(tmp_path / "out"), "db", ["id"], F.col("id") > 1)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("db", "id")) == [("b", 2)]
    with pytest.raises(Exception, match="exists"):
        reg.export(df, str(tmp_path / "out"), "db", ["id"])


def test_near_pairs(spark):
    base = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, "en", base), (2, "en", base), (3, "en", base + " w80 w81"), (4, "en", "else"), (5, "fr", base), (6, "en", ""), (7, "en", None)], "id int, lang string, text string")
    assert sorted(rows(dedup.near_pairs(df, "id", "text", ["lang"]).select("a", "b"))) == [(1, 2), (1, 3)]


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"db_id": "a"}, {"db_id": "b"}]')
    (tmp_path / "r.jsonl").write_text('{"db_id": "a"}\n{"db_id": "a"}\n')
    assert files.read_registry(spark, str(tmp_path / "r.json"), "db_id string", "db_id").count() == 2
    with pytest.raises(ValueError, match="repeats"):
        files.read_registry(spark, str(tmp_path / "r.jsonl"), "db_id string", "db_id")
    files.write_lines(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == '{"a":null,"b":1}'
    from tessera.plans.catalog import star_catalog

    files.write_snapshot(spark, star_catalog(), str(tmp_path / "snap"))
    assert files.read_snapshot(spark, str(tmp_path / "snap")) == star_catalog()
    assert files.expand("${A}/${B:-x}", {"A": "1"}) == "1/x"
    with pytest.raises(KeyError):
        files.expand("${C}", {})
    with pytest.raises(ValueError):
        files.strict({"a": 1}, {"b"})


def test_flow_batches(spark):
    ev = spark.createDataFrame([("p", 1, datetime(2020, 1, 1, 0, 0, 0), True), ("p", 2, datetime(2020, 1, 1, 0, 0, 30), True), ("p", 3, datetime(2020, 1, 1, 0, 5, 0), False)], "k string, id int, ts timestamp_ntz, bad boolean")
    assert rows(flows.rolling_errors(ev, "k", "ts", F.col("bad"), 60).orderBy("id").select("n", "errors")) == [(1, 1), (2, 2), (1, 0)]
    assert rows(flows.breaker_openings(ev, "k", "ts", F.col("bad"), 60, 2, 0.5).select("id")) == [(2,)]
    assert rows(flows.runs(ev, ["k"], ["id"], F.col("bad"))) == [("p", 2, 1, 2)]
    assert rows(flows.stalls(ev, "k", "ts", "id", 100).select("id")) == [(3,)]
    assert rows(flows.sequence_faults(ev, "k", "id")) == []


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return rows(spark.table(name))
    finally:
        q.stop()


def test_breaker_stream(spark, tmp_path):
    lines = [("p", float(t), bad) for t, bad in ((0, True), (10, True), (20, False), (80, False), (81, True))]
    files.write_lines(spark.createDataFrame(lines, "key string, ts double, failed boolean").coalesce(1), str(tmp_path / "in"))
    src = spark.readStream.schema("key string, ts double, failed boolean").json(str(tmp_path / "in"))
    out = run_stream(spark, flows.breaker_stream(src, 60, 2, 0.5, 30), "breaker")
    assert [r[-1] for r in sorted(out, key=lambda r: r[1])] == ["closed", "open", "open", "closed", "open"]  # the window outlives the recovery


def test_backoff_stream(spark, tmp_path):
    lines = [("p", float(t), bad) for t, bad in ((0, True), (1, True), (2, True), (3, False), (4, True))]
    files.write_lines(spark.createDataFrame(lines, "key string, ts double, discarded boolean").coalesce(1), str(tmp_path / "in"))
    src = spark.readStream.schema("key string, ts double, discarded boolean").json(str(tmp_path / "in"))
    out = run_stream(spark, flows.backoff_stream(src, 3, 60), "backoff")
    assert [(r[2], r[3]) for r in sorted(out, key=lambda r: r[1])] == [(1, False), (2, False), (3, True), (0, False), (1, False)]


def test_tumbling_stream(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 0, m), "a") for m in (0, 1, 6, 30)], "ts timestamp, k string")
    files.write_lines(df.coalesce(1), str(tmp_path / "in"))
    src = flows.event_stream(spark, str(tmp_path / "in"), "ts timestamp, k string")
    out = run_stream(spark, flows.tumbling(src, "ts", "5 minutes", "1 minute", "k"), "tumbling", "complete")
    assert sorted(r[-1] for r in out) == [1, 1, 2]
