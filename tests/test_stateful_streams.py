"""Stateful streams: their batch twins over the same events, restarts between parts, and timers."""

import random
import time

from pyspark.sql import functions as F

from tessera.streaming import stateful, states


def events(spark, n=300, keys=3):
    rng = random.Random(6)
    rows, at = [], dict.fromkeys(range(keys), 0)
    for i in range(n):
        k = rng.randrange(keys)
        at[k] += rng.choice([0, 500_000, 1_000_000, 3_000_000, 15_000_000])
        rows.append((str(k), at[k], i, rng.choice([True, False, None])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, ts long, tie long, flag boolean"), max(at.values())


def cut(df, last, parts=3):
    return [df.where(F.floor(F.col("ts") * parts / (last + 1)) == k) for k in range(parts)]


def test_breaker_and_backoff_over_parts(spark, tmp_path):
    df, last = events(spark)
    timed = df.withColumn("at", F.timestamp_micros("ts"))
    got = {r.tie: (r.n, r.errors, r.state) for r in stateful.over_split(spark, cut(df, last), stateful.Breaker(10_000_000, 3, 0.4, 8_000_000), str(tmp_path / "b")).collect()}
    assert got == {r.tie: (r.n, r.errors, r.state) for r in states.breaker_states(timed, "key", "at", "tie", F.col("flag"), 10, 3, 0.4, 8).collect()}
    assert {s for *_, s in got.values()} == {"closed", "open", "probe"}
    got = {r.tie: (r.discards, r.until and r.until / 1e6) for r in stateful.over_split(spark, cut(df, last), stateful.Backoff(2, 10_000_000), str(tmp_path / "o")).collect()}
    assert got == {r.tie: (r.discards, r.backoff_until) for r in states.backoff_states(timed, "key", "at", "tie", F.col("flag"), 2, 10).collect()}


def test_stall_timer(spark, tmp_path):
    stateful.settings(spark)
    df = spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, None), ("b", 1, 3, None)], "key string, ts long, tie long, flag boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stateful.checked(stream, stateful.Stall(3_000)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        began, got = time.time(), set()
        while time.time() - began < 90 and len(got) < 4 and query.isActive:
            time.sleep(1)
            got = {(r.key, r.events, r.status) for r in spark.read.schema(stateful.Stall.OUT).parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()
        assert query.exception() is None
        assert got == {("a", 2, "active"), ("b", 1, "active"), ("a", 2, "stalled"), ("b", 1, "stalled")}
    finally:
        query.stop()


def test_a_key_costs_few_calls():
    """Handlers take rows as they are, and ask the store for a key's state once."""
    from pyspark.sql import Row

    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        def getValueState(self, *_):
            return State()

    check = stateful.Backoff(2, 10)
    check.init(Handle())
    run = lambda *x: [tuple(r) for r in check.handleInputRows(("k",), iter([Row(key="k", ts=t, tie=i, flag=b) for i, (t, b) in enumerate(x)]), None)]
    assert run((5, False)) == [("k", 0, 0, None)] and calls == ["get"]
    assert run((7, True), (6, True)) == [("k", 1, 1, None), ("k", 0, 2, 17)] and calls == ["get", "get", "update"]
    assert run((20, False)) == [("k", 0, 0, None)] and calls[3:] == ["get", "clear"]
