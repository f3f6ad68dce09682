"""Checks of event flows: batch forms as the truth, streaming forms with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.streaming.states import carried, chunk_of, micros, trailing


def rolling_errors(events: DataFrame, key: str, ts: str, failed: Column, seconds: int) -> DataFrame:
    """Adds n, errors and rate of each event's trailing window, its own time included. A key's history is split by stretches of the window's length."""
    rows = events.withColumn("failed", failed).withColumn("_t", micros(ts))
    out = trailing(rows, key, "_t", "_t", seconds * 1_000_000, {"n": F.lit(True), "errors": F.coalesce("failed", F.lit(False))}, peers=True).drop("_t")
    return out.withColumn("rate", F.col("errors") / F.col("n"))


def breaker_openings(events: DataFrame, key: str, ts: str, failed: Column, seconds: int, least: int, rate: float) -> DataFrame:
    """Failures at which a closed breaker would open: enough events in the window and the rate reached."""
    return rolling_errors(events, key, ts, failed, seconds).where(F.col("failed") & (F.col("n") >= least) & (F.col("rate") >= rate))


def runs(events: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """Unbroken runs of hits: keys, run_length, first and last position. A key's history is numbered in chunks of its first order column."""
    rows = events.withColumn("_h", hit).withColumn("_flow", F.struct(*keys)).withColumn("_part", chunk_of(events, order[0]))
    rows = carried(rows, "_flow", "_part", order, {}, sums={"_i": F.lit(1), "_g": F.when(F.col("_h"), 0).otherwise(1)}).where("_h")
    return rows.groupBy(*keys, "_g").agg(F.count("*").alias("run_length"), F.min("_i").cast("bigint").alias("first_pos"), F.max("_i").cast("bigint").alias("last_pos")).drop("_g")


def stalls(events: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Events that come more than `seconds` after the one before, with the gap."""
    rows = carried(events.withColumn("_part", chunk_of(events, ts)), key, "_part", [ts, tie], {"_before": F.struct(F.col(ts).alias("ts"))}, inclusive=False)
    gap = (micros(ts) - micros(F.col("_before.ts"))) / 1_000_000
    return rows.drop("_part").withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds).drop("_before")


def sequence_faults(events: DataFrame, flow: str, seq: str) -> DataFrame:
    """Flows whose numbers do not run 1, 2, 3, ...: flow, events, least, greatest, different."""
    out = events.groupBy(flow).agg(F.count("*").alias("events"), F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count_distinct(seq).alias("kinds"))
    return out.where("lo <> 1 or hi <> events or kinds <> events")


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """JSON-lines files as they arrive; nothing is dropped, a trigger takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows, closed by the watermark; an extension beside the flow checks."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


BREAKER_STATE = "times array<double>, fails array<boolean>, open_until double"
BREAKER_OUT = "key string, ts double, failed boolean, n long, errors long, state string"


def breaker_stream(events: DataFrame, seconds: float, least: int, rate: float, probe: float) -> DataFrame:
    """The circuit breaker with its state by key. events: key string, ts double (seconds), failed boolean.

    Opens at a failure with enough events in the window and the rate reached, for `probe` seconds; a success after that
    closes it, and the window stays. State holds the window's events only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, fails, until = (deque(state.get[0]), deque(state.get[1]), state.get[2]) if state.exists else (deque(), deque(), 0.0)
        bad_ones = sum(fails)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for t, bad in zip(rows["ts"], rows["failed"], strict=True):
            t, bad = float(t), bool(bad)
            times.append(t)
            fails.append(bad)
            bad_ones += bad
            while times and times[0] < t - seconds:
                times.popleft()
                bad_ones -= fails.popleft()
            if until and t >= until and not bad:
                until = 0.0
            elif bad and len(times) >= least and bad_ones / len(times) >= rate:
                until = t + probe
            out.append((key[0], t, bad, len(times), bad_ones, "open" if until and t < until else "probe" if until else "closed"))
        state.update((list(times), list(fails), until))
        yield pd.DataFrame(out, columns=["key", "ts", "failed", "n", "errors", "state"])

    return events.groupBy("key").applyInPandasWithState(step, BREAKER_OUT, BREAKER_STATE, "append", GroupStateTimeout.NoTimeout)


def backoff_stream(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Backoff by key after `limit` discards in a row. events: key string, ts double, discarded boolean. A success, or the end of the backoff, starts anew."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, 0.0)
        out = []
        for t, bad in pd.concat(list(batches)).sort_values("ts", kind="stable")[["ts", "discarded"]].itertuples(index=False):
            if until and t >= until:
                count, until = 0, 0.0
            count = count + 1 if bad else 0
            until = t + seconds if bad and count >= limit else until if bad else 0.0
            out.append((key[0], float(t), int(count), bool(until)))
        state.update((int(count), float(until)))
        yield pd.DataFrame(out, columns=["key", "ts", "discards", "backing_off"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, ts double, discards long, backing_off boolean", "discards long, until double", "append", GroupStateTimeout.NoTimeout)


def stall_stream(events: DataFrame, milliseconds: int) -> DataFrame:
    """Keys that stay idle: a row of status 'stalled' when no event comes for the time, and 'active' for each batch of events. events: key string, ts double."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], seen, "stalled")], columns=["key", "events", "status"])
            return
        seen = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((int(seen),))
        state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame([(key[0], int(seen), "active")], columns=["key", "events", "status"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, events long, status string", "events long", "append", GroupStateTimeout.ProcessingTimeTimeout)
