import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import canonical as can
from tessera.operators import calibration as cal
from tessera.operators import dedup, drafts, explore
from tessera.plans.catalog import star_catalog
from tessera.sources import files
from tessera.sources.runs import RunStore
from tessera.sources.tables import read_table

ROOT = "/root/testdata/sf0.001"
GOOD = '<entity>\n{"customer": 7}\n</entity>\n\nWhich orders are open?'


YAML = """
database:
  dsn: "${DSN_NOT_SET_HERE:-local}"   # a comment
  pool: 32
providers:
  one: {type: plain, retries: 3}
  two:
    type: other
models:
  solvers:
    - {provider: one, model: "m-1"}
    - {provider: two, model: 'm: 2'}
text: |
  two
  lines
"""


def test_yaml(spark, capsys, tmp_path):
    (tmp_path / "c.yaml").write_text(YAML)
    config = files.read_config(spark, str(tmp_path / "c.yaml"))
    assert config["database"] == {"dsn": "local", "pool": 32} and config["models"]["solvers"][1] == {"provider": "two", "model": "m: 2"} and config["text"] == "two\nlines\n"
    assert files.read_config(spark, str(tmp_path / "c.yaml"), {"DSN_NOT_SET_HERE": "x: y"})["database"]["dsn"] == "x: y"
    shape = {"database": {"dsn", "pool"}, "providers": {"*": {"type", "retries"}}, "models": {"solvers": {"provider", "model"}}, "text": None}
    assert files.strict(config, shape) is config
    for odd, where in (({"pool": 1, "pol": 2}, "database.pol"), ({"*": {}}, None)):
        with pytest.raises(ValueError, match=(where or "unknown").replace("*", ".")):
            files.strict(config | {"database": odd}, shape)
    with pytest.raises(ValueError, match="providers.two.kind"):
        files.strict(config | {"providers": {"two": {"kind": 1}}}, shape)
    (tmp_path / "bad.yaml").write_text("a: [1\nb: }")
    with pytest.raises(ValueError, match="no YAML"):
        files.read_config(spark, str(tmp_path / "bad.yaml"))
    path = str(tmp_path / "c.yaml")
    assert said(capsys, spark, "validate-config", path, "--known", "database.dsn", "database.pool", "providers", "models", "text")[0] == 0
    assert said(capsys, spark, "validate-config", path, "--known", "database.dsn", "providers", "models", "text")[0] == 1


def test_run_store(spark, capsys, tmp_path):
    path = str(tmp_path / "run")
    store = RunStore(spark, path, buckets=4)
    assert store.summaries().count() == 0
    code, made = said(capsys, spark, "bootstrap-run-db", path)
    assert code == 0 and "tasks" in made["created"] and said(capsys, spark, "bootstrap-run-db", path)[1]["created"] == []
    tasks = lambda *rows: spark.createDataFrame(rows, "task_id string, run_id string, status string, payload_json string")
    store.record("tasks", tasks(("a", "r", "draft", "{}"), ("b", "r", "rejected", "{}"), ("c", "s", "accepted", None)), 0)
    store.record("tasks", tasks(("a", "r", "accepted", '{"n":1}')), 1)
    store.record("tasks", tasks(("a", "r", "draft", "{}"), ("b", "r", "rejected", "{}"), ("c", "s", "accepted", None)), 0)  # it comes again
    assert {r.task_id: r.status for r in store.read("tasks").collect()} == {"a": "accepted", "b": "rejected", "c": "accepted"}
    log = lambda *rows: spark.createDataFrame(rows, "run_id string, event_type string, payload_json string")
    store.record("event_log", log(("r", "start", "{}"), ("r", "end", "{}")), 0)
    store.record("event_log", log(("s", "start", "{}")), 1)
    store.record("event_log", log(("s", "start", "{}")), 1)
    assert sorted((r.log_id, r.run_id) for r in store.read("event_log").collect()) == [(1, "r"), (2, "r"), (3, "s")]
    store.record("verification_results", spark.createDataFrame([("a", "r", "x", "{}"), ("a", "r", "y", "{}"), ("a", "r", "x", "{}")], "task_id string, run_id string, solver_id string, payload_json string"), 0)
    assert said(capsys, spark, "run-db-summary", path, "r")[1] == {"run_id": "r", "total": 2, "accepted": 1, "rejected": 1, "other": 0, "verification_results": 2, "event_count": 2}
    assert said(capsys, spark, "run-db-summary", path, "none")[1]["total"] == 0
    store.record("processed_keys", spark.createDataFrame([("n", "1", None)], "namespace string, item_key string, payload_json string"), 0)
    items = spark.createDataFrame([("1",), ("2",)], "k string")
    assert [r.k for r in store.unprocessed("n", items, "k").collect()] == ["2"] and store.unprocessed("m", items, "k").count() == 2


def said(capsys, spark, *arguments):
    code = cli.main(arguments, spark)
    out = capsys.readouterr()
    return code, json.loads(out.out) if out.out else out.err


def test_commands(spark, capsys, tmp_path):
    assert set(said(capsys, spark, "check-db")[1]) == {"database_name", "user_name", "schema_name"}
    assert "where_eq" in said(capsys, spark, "show-layout")[1]["queries"]
    assert said(capsys, spark, "query", ROOT, "where_eq")[1][0]["cnt"] > 0
    code, rows = said(capsys, spark, "show-task-registry", ROOT, "events", "--columns", "event_id", "--created", "ts", "--key", "event_id", "--where", "event_type=click", "--limit", "3")
    assert code == 0 and len(rows) == 3 and rows[0]["task_count"] > 3
    assert said(capsys, spark, "plan-synthesis-coverage", ROOT, "documents", "--columns", "lang", "--target", "100")[1][0]["deficit"] > 0
    assert said(capsys, spark, "run-summary", ROOT, "events", "event_type", "purchase", "error")[1]["total"] == 1000
    assert said(capsys, spark, "export-bundle", ROOT, "orders", str(tmp_path / "out"), "--by", "o_orderstatus", "--key", "o_orderkey", "--having", "o_orderkey < 50")[0] == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    (tmp_path / "c.json").write_text('{"a": "${NOT_SET_HERE:-1}"}')
    assert said(capsys, spark, "validate-config", str(tmp_path / "c.json"), "--known", "a")[1] == {"valid": True, "keys": ["a"]}
    assert said(capsys, spark, "validate-config", str(tmp_path / "c.json"))[0] == 1
    assert said(capsys, spark, "query", ROOT, "no such")[0] == 1


@pytest.mark.parametrize(
    ("code", "change"),
    [
        (None, {}),
        ("topic_required", {"topic": " "}),
        ("anchor_entity_required", {"anchor": "{}"}),
        ("anchor_entity_required", {"anchor": "{bad"}),
        ("anchor_entity_scalar_map_required", {"anchor": '{"a": [1]}'}),
        ("canonical_answer_json_invalid", {"answer": "[1"}),
        ("question_required", {"question": None}),
        ("question_entity_block_required", {"question": "Which?"}),
        ("question_entity_block_invalid_json", {"question": GOOD.replace("{", "(")}),
        ("question_entity_block_mismatch", {"question": GOOD.replace("7", "8")}),
        ("question_raw_identifier_leak", {"anchor": '{"customer_id": 7}', "question": '<entity>\n{"customer_id": 7}\n</entity>\n\nWhich has customer_id 7?'}),
        ("question_raw_identifier_leak", {"question": GOOD + " Name its order_IDs."}),
        (None, {"question": GOOD + " Is <b>it</b> {x} paid_ or grid?"}),
        ("question_entity_placeholder_forbidden", {"question": GOOD + " Of <Entity>?"}),
        ("question_entity_placeholder_forbidden", {"question": GOOD + " Of &lt;entity&gt;?"}),
        ("label_blank_string_forbidden", {"answer": '[{"a": " "}]'}),
        ("label_values_not_grounded", {"answer": '["closed"]'}),
        ("canonical_answer_json_invalid", {"answer": "{}"}),
        ("canonical_answer_json_invalid", {"answer": '"Open"'}),
        ("question_entity_block_invalid_json", {"question": GOOD.replace('{"customer": 7}', "[7]")}),
        (None, {"question": GOOD.replace("7", "7.0"), "observed": None}),
        ("no_new_grounded_observation", {"new_calls": 0}),
        ("label_not_strengthened", {"refused": '[ "Open " ]'}),
        (None, {"refused": '["open"]'}),
        ("draft_validation_failed", {"answer": '["open", 1]'}),
        ("draft_validation_failed", {"answer": '[{"a": "open"}, {"b": "open"}]'}),
        ("reject_too_easy", {"verdict": "too_easy"}),
        ("reject_too_hard", {"verdict": "too_hard"}),
        (None, {"verdict": "accept"}),
    ],
)
def test_draft_codes(spark, code, change):
    draft = {"topic": "orders", "anchor": '{"customer": 7}', "answer": '["Open "]', "question": GOOD, "observed": '[{"status": "open"}]', "new_calls": None, "refused": None, "verdict": None} | change
    assert drafts.check_draft(*draft.values()) == code and (code is None or code in drafts.CODES)
    df = spark.createDataFrame([tuple(draft.values())], ", ".join(f"{c} {'int' if c == 'new_calls' else 'string'}" for c in draft))
    assert df.select(drafts.draft_code(*(F.col(c) for c in draft))).first()[0] == code


def test_draft_payloads(spark):
    payload = {"topic": "orders", "entity": '{"customer": 7}', "label": ["Open "], "question": GOOD}
    rows = [(json.dumps(payload), None), (json.dumps(payload | {"label": '["Open "]'}), None), (json.dumps(payload | {"more": 1}), "submit_payload_invalid"), ("[]", "submit_payload_invalid"), ("{", "submit_payload_invalid"), (None, "submit_payload_invalid"), ("{}", "topic_required")]
    df = spark.createDataFrame([(p, '"open"', None, None, None) for p, _ in rows], "p string, o string, n int, r string, v string")
    assert [r.code for r in drafts.checked_payloads(df, "p", "o", "n", "r", "v").collect()] == [c for _, c in rows]


def test_results_and_previews():
    assert drafts.plain({1: [date(2020, 1, 2), datetime(2020, 1, 2, 3), Decimal("1.50"), ("a  ",)]}) == {"1": ["2020-01-02", "2020-01-02T03:00:00", "1.50", ["a"]]}
    assert drafts.preview({"a": "x" * 9, "b": [1, 2, 3], "c": 1}, 4, 2, 2) == {"a": "xxxx", "b": [1, 2]}
    assert drafts.strengthened({"a": 1}, {"a": 1, "b": 2}) and not drafts.strengthened([1], [2])
    assert drafts.blank_paths({"a": [" ", "x"]}) == ["$.a[0]"]


def test_split_prompts(spark):
    got = drafts.split_prompts(spark.createDataFrame([(GOOD,), ("Which?",), (None,), ("",)], "q string"), "q").collect()
    assert [(r.has_entity, r.entity_json, r.body) for r in got] == [(True, '{"customer": 7}', "Which orders are open?")] + [(False, None, None)] * 3


def test_float_aggregates_are_exact(spark):
    from tessera.operators.calculus import aggregated
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.004,), (0.004,), (0.004,), (1.005,), (None,)], "x double")
    row = df.agg(aggregated(F.col("x"), "sum", "double").alias("s"), aggregated(F.col("x"), "avg", "double").alias("a")).first()
    assert row.s == pytest.approx(1.017, abs=1e-12) and row.a == pytest.approx(0.25425, abs=1e-12)


def test_divergence_of_spellings(spark):
    rows = [(1, '{"a": 1, "b": 2}'), (1, '{"b":2,"a":1}'), (1, ""), (1, None), (2, "x"), (2, "x "), (2, "{bad")]
    got = {r.k: (r.submissions, r.answers, r.divergence) for r in cal.divergence(spark.createDataFrame(rows, "k int, a string"), "k", "a").collect()}
    assert got == {1: (2, 1, 0.5), 2: (3, 3, 1.0)}


def test_contracts_and_dates():
    assert can.canonicalize("2020-01-01T10:00:00", can.Field("date")) == can.canonicalize("2020-01-01T10:00:00Z", can.Field("date")) == "2020-01-01"
    with pytest.raises(ValueError):
        can.Field("list", items=can.Field("int"), ordered=True, unique=True)
    with pytest.raises(can.Mismatch):
        can.canonicalize("2020-13-01", can.Field("date"))


def test_pairs_of_null_scope(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, None), (2, text, None), (3, text, "a"), (4, text, "null")], "id int, t string, s string")
    assert [tuple(r) for r in dedup.near_pairs(df, "id", "t", ["s"]).collect()] == [(1, 2, 1.0)]


def test_neighborhood_of_an_absent_row(spark):
    got = explore.neighborhood(star_catalog(), lambda n: read_table(spark, ROOT, n), "customer", 10**9)
    assert got.count() == 0
