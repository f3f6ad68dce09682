"""Histories of breakers, backoffs, budgets and tool calls against plain sequential Python."""

import json
import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.operators import anchors, budget
from tessera.streaming import states

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def history(rng, keys, n, spread, forced=0.0):
    rows, times = [], dict.fromkeys(range(keys), 0.0)
    for i in range(n):
        k = min(int(rng.expovariate(0.7)), keys - 1)
        times[k] += rng.choice([0, 0.5, 1, 2, 5, spread])
        rows.append((i, str(k), START + timedelta(seconds=times[k]), rng.random() < 0.55, rng.random() < forced))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_breaker(spark, seed):
    rng = random.Random(seed)
    rows = history(rng, 4, 400, 30, 0.03)
    df = spark.createDataFrame([*rows, (9999, "0", None, True, False)], "i long, key string, ts timestamp, bad boolean, forced boolean").withColumn("cool", F.when(F.col("i") % 2 == 0, 3.0))
    got = {r.i: r for r in states.breaker_states(df, "key", "ts", "i", F.col("bad"), 10, 3, 0.5, 8, F.col("forced"), F.col("cool")).collect()}
    assert len(got) == len(rows)
    past, until = {}, {}
    for i, key, ts, bad, forced in sorted(rows, key=lambda r: (r[2], r[0])):
        t = (ts - START).total_seconds()
        h = past.setdefault(key, deque())
        if forced:
            until[key] = t + (3 if i % 2 == 0 else 8)
        else:
            h.append((t, bad))
        while h and t - h[0][0] > 10:
            h.popleft()
        n, errors = len(h), sum(b for _, b in h)
        if not forced:
            if bad and n >= 3 and errors / n >= 0.5:
                until[key] = t + 8
            elif not bad and until.get(key) is not None and t >= until[key]:
                until[key] = None
        u = until.get(key)
        state = "closed" if u is None else "open" if t < u else "probe"
        r = got[i]
        assert (r.n, r.errors, r.state, r.available) == (n, errors, state, state != "open"), (i, key)
        assert r.cooldown_remaining_s == pytest.approx(u - t if state == "open" else 0)
        assert r.error_rate == pytest.approx(errors / n if n else 0)


@pytest.mark.parametrize("limit", [1, 2, 3, 7])
def test_backoff(spark, limit, monkeypatch):
    monkeypatch.setattr(states, "BLOCK", 3)
    rng = random.Random(limit)
    rows = [(i, k, t, rng.random() < 0.9) for i, k, t, *_ in history(rng, 3, 500, 12)]
    df = spark.createDataFrame(rows, "i long, key string, ts timestamp, bad boolean")
    got = {r.i: r for r in states.backoff_states(df, "key", "ts", "i", F.col("bad"), limit, 10).collect()}
    assert len(got) == len(rows)
    state = {}
    for i, key, ts, bad in sorted(rows, key=lambda r: (r[2], r[0])):
        count, until = state.get(key, (0, None))
        if until is not None and ts >= until:
            count, until = 0, None
        count = count + 1 if bad else 0
        until = ts + timedelta(seconds=10) if bad and count >= limit else until if bad else None
        state[key] = (count, until)
        assert got[i].discards == count, (i, key)
        assert got[i].backoff_until == (until.timestamp() if until else None)


def test_budget(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        run = rng.choice("aab")
        kind = rng.choice(["reserve", "reserve", "settle", "release", "odd"])
        amounts = [None if rng.random() < 0.3 else float(rng.randrange(5)) for _ in range(3)]
        rows.append((i, run, kind, str(rng.randrange(i // 4, i + 1) if kind == "reserve" else rng.randrange(max(1, i))), *amounts))
    df = spark.createDataFrame(rows, "i long, run string, kind string, id string, c double, s double, g double")
    got = {r.i: r for r in budget.ledger(df, "run", ["i"], "kind", "id", ["c", "s", "g"], 40.0, 30.0).collect()}
    runs, seen = {}, set()
    for i, run, kind, name, *amounts in rows:
        spent, held = runs.setdefault(run, ([0.0] * 3, {}))
        now = [sum(h[k] for h in held.values()) for k in range(3)]
        if kind == "reserve":
            new = [a or 0.0 for a in amounts]
            if sum(spent[:2]) + sum(now[:2]) + sum(new[:2]) > 40 or spent[2] + now[2] + new[2] > 30:
                want = "refused"
            elif name in held:
                want = "unknown"
            else:
                held[name], want = new, "reserved"
        elif name not in held or kind == "odd":
            want = "unknown"
        else:
            was = held.pop(name)
            want = "settled" if kind == "settle" else "released"
            if kind == "settle":
                for k in range(3):
                    spent[k] += was[k] if amounts[k] is None else amounts[k]
        seen.add(want)
        r = got[i]
        assert r.status == want, i
        assert [r.spent_compose, r.spent_solve, r.spent_gpu] == spent
        assert [r.reserved_compose, r.reserved_solve, r.reserved_gpu] == [sum(h[k] for h in held.values()) for k in range(3)]
    assert seen == set(budget.STATUSES)


def test_abort(spark):
    df = spark.createDataFrame([(0, 0), (1, 9), (1, 10), (2, 10), (None, 10)], "accepted int, attempted int")
    assert [r[0] for r in df.select(budget.should_abort(F.col("accepted"), F.col("attempted"), 0.2, 10)).collect()] == [False, False, True, False, False]


def test_anchor_replay(spark):
    rng = random.Random(11)
    pool = [1, 1.0, 2, True, "Ann", " ann ", "bo", "Cy", "x", None, "2"]
    scalar = lambda: rng.choice(pool)
    calls, anchor, answers = [], {}, {}
    for task in range(40):
        anchor[task] = {"id": scalar(), "n": scalar()}
        for no in range(rng.randrange(9)):
            params = {f"p{k}": rng.choice([scalar(), [scalar()], {"q": scalar()}]) for k in range(rng.randrange(3))}
            result = rng.choice([scalar(), [scalar(), {"a": scalar()}], {"b": [scalar()], "c": scalar()}])
            calls.append((task, no, params, result))
        answers[task] = {"l": [scalar() for _ in range(4)], "m": scalar()}
    anchor[3] = None
    frame = spark.createDataFrame([(t, n, json.dumps(p), json.dumps(r)) for t, n, p, r in calls], "task int, no int, params string, result string")
    starts = spark.createDataFrame([(t, None if a is None else json.dumps(a)) for t, a in anchor.items()], "task int, anchor string")
    said = spark.createDataFrame([(t, json.dumps(a)) for t, a in answers.items()], "task int, answer string")
    got = {(r.task, r.value) for r in anchors.disconnected_strings(said, frame, starts, "task", "no", "params", "result", "anchor", "answer").collect()}

    def leaves(v, everything):
        if isinstance(v, dict):
            return {x for i in v.values() for x in leaves(i, everything)}
        if isinstance(v, list):
            return {x for i in v for x in leaves(i, everything)}
        if isinstance(v, str):
            return {v, v.strip().lower()} if everything else {v.strip().lower()} - {""}
        return {v} if everything and v is not None else set()

    want = set()
    for task in anchor:
        known, connected, shown = set(), set(), set()
        if anchor[task] is not None:
            known = {v for v in anchor[task].values()} | {v.strip().lower() for v in anchor[task].values() if isinstance(v, str)}
        for t, _, params, result in calls:
            if t != task:
                continue
            shown |= leaves(result, False)
            flat = [v for v in params.values() if not isinstance(v, (dict, list))]
            if anchor[task] is None or any(v in known or (isinstance(v, str) and v.strip().lower() in known) for v in flat):
                connected |= leaves(result, False)
                known |= leaves(result, True)
        want |= {(task, v) for v in (leaves(answers[task], False) & shown) - connected}
    assert got == want and want


def test_text_without_escapes_is_taken_as_it_is(spark):
    """A string's escapes are put back for those that have some, once, and its text is the same as by Python's json."""
    import json
    import re

    from tessera.functions import json_leaves as J

    values = ["plain", "Two Words", 'a"b', "back\\slash", "\\", '"', "tab\tnew\nline", "é中", "\\\\u0041", "x\\n"]
    df = spark.createDataFrame([(json.dumps([v, {"k": v}]),) for v in values] + [('["\\u0041b"]',)], "x string").select(J.string_leaves(F.col("x")).alias("v"))
    assert [r.v for r in df.collect()] == [[v.lower().strip(" \t\n\r\x0b\x0c")] * 2 for v in values] + [["ab"]]
    assert len(re.findall(r"(?<!regexp_)replace\(", df._jdf.queryExecution().analyzed().toString())) <= 4
