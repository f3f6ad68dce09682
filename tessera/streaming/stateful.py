"""Flow checks as stateful streams, with typed state in the RocksDB store: each key's state is read, and what changed is written, when events of the key come. Rows go to and fro in batches of many keys, which a frame for each key would not.

A stream needs settings(spark) before it starts. Events of one trigger are taken in the order of (ts, tie); triggers come in
the order of time, as files of a log do.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settings(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(rows: Iterator[Row]) -> list[tuple]:
    """(ts, tie, flag) of a key's events of one trigger."""
    return sorted((r["ts"], r["tie"], r["flag"]) for r in rows)


class Breaker(StatefulProcessor):
    """tessera.streaming.states.breaker_states() as events come. The window is a list to which events are added; it is rewritten only when some have left it."""

    OUT = "key string, tie long, n long, errors long, state string"

    def __init__(self, micros: int, least: int, rate: float, probe: int):
        self.micros, self.least, self.rate, self.probe = micros, least, rate, probe

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "t long, bad boolean")
        self.until = handle.getValueState("until", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = deque((int(t), bool(b)) for t, b in self.window.get())
        known, left, errors = len(held), 0, sum(b for _, b in held)
        until = self.until.get()[0] if self.until.exists() else None
        was, out = until, []
        for t, tie, bad in _in_order(rows):
            t, bad = int(t), bool(bad)
            held.append((t, bad))
            errors += bad
            while t - held[0][0] > self.micros:
                errors -= held.popleft()[1]
                left += 1
            if bad and len(held) >= self.least and errors / len(held) >= self.rate:
                until = t + self.probe
            elif not bad and until is not None and t >= until:
                until = None
            out.append((key[0], int(tie), len(held), errors, "closed" if until is None else "open" if t < until else "probe"))
        if left:
            self.window.put(list(held))
        else:
            self.window.appendList(list(held)[known:])
        if until is None and was is not None:
            self.until.clear()
        elif until != was:
            self.until.update((until,))
        for key_, tie, n, errors, state in out:
            yield Row(key=key_, tie=tie, n=n, errors=errors, state=state)

    def close(self) -> None:
        pass


class Backoff(StatefulProcessor):
    """tessera.streaming.states.backoff_states() as events come."""

    OUT = "key string, tie long, discards long, until long"

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "discards long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get()  # None if there is none: each call goes to the JVM and back
        count, until = (0, None) if before is None else before
        out = []
        for t, tie, bad in _in_order(rows):
            t = int(t)
            if until is not None and t >= until:
                count, until = 0, None
            count = count + 1 if bad else 0
            until = (t + self.micros if count >= self.limit else until) if bad else None
            out.append((key[0], int(tie), int(count), until))
        if count:
            self.state.update((int(count), until))
        elif before is not None:
            self.state.clear()  # a success leaves nothing to keep
        for key_, tie, discards, until in out:
            yield Row(key=key_, tie=tie, discards=discards, until=until)

    def close(self) -> None:
        pass


class Stall(StatefulProcessor):
    """'active' with the events so far for each trigger that brings some, and 'stalled' once none has come for so long: each event puts the key's one timer off."""

    OUT = "key string, events long, status string"

    def __init__(self, milliseconds: int):
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = (self.seen.get()[0] if self.seen.exists() else 0) + sum(1 for _ in rows)
        self.seen.update((int(seen),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        yield Row(key=key[0], events=int(seen), status="active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = self.seen.get()[0]
        self.seen.clear()
        yield Row(key=key[0], events=int(seen), status="stalled")

    def close(self) -> None:
        pass


def checked(events: DataFrame, check: Breaker | Backoff | Stall) -> DataFrame:
    """The stream of a check's rows. events: key string, ts long (microseconds), tie long, flag boolean (whether it failed or was discarded; a null one did not)."""
    rows = events.fillna({"flag": False})
    return rows.groupBy("key").transformWithState(check, check.OUT, "Append", "ProcessingTime" if isinstance(check, Stall) else "None")


def over_split(spark: SparkSession, parts: list[DataFrame], check: Breaker | Backoff, folder: str) -> DataFrame:
    """A check's rows over events that come in parts which follow each other in time. The stream takes what there is and ends after each part, and goes on from its checkpoint with the next."""
    settings(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        query = checked(stream, check).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(check.OUT).parquet(f"{folder}/out")
