"""Which tool calls of a task are connected with its anchor, by replaying them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import json_leaves as J
from tessera.sources.scratch import written


def connected_calls(calls: DataFrame, anchors: DataFrame, task: str, no: str, params: str, result: str, anchor: str) -> DataFrame:
    """(task, no) of calls that are connected: one of the call's own scalar parameters is a value of the anchor, or a scalar in the result of a connected call before it.

    params, result and anchor are JSON; what is none, or no object, has no values. Text is compared without case and white
    space around it. A task without an anchor, or with a null one, has all of its calls connected.

    Each round takes the values that calls of the round before made known, each from its first place on, to the calls
    after these that are not connected yet; as many rounds as the longest chain of calls is long.
    """
    rows = calls.select(F.col(task).alias("task"), F.col(no).alias("no"), F.col(params).alias("p"), F.col(result).alias("r"))
    start = anchors.where(F.col(anchor).isNotNull()).select(F.col(task).alias("task"), F.col(anchor).alias("a"))
    asked = written(rows.select("task", "no", F.explode(F.array_distinct(J.flat_object(F.col("p")))).alias("value")), "anchor-asked")
    given = written(rows.select("task", "no", F.explode(F.array_distinct(J.scalar_leaves(F.col("r")))).alias("value")), "anchor-given")
    known = start.select("task", F.explode(J.flat_object(F.col("a"))).alias("value")).distinct().withColumn("since", F.lit(None).cast(rows.schema["no"].dataType))
    free = rows.join(start.select("task"), "task", "left_anti").select("task", "no")
    found = []
    done = None
    while True:
        after = F.col("since").isNull() | (F.col("no") > F.col("since"))
        hits = asked.join(known, ["task", "value"]).where(after).select("task", "no").distinct()
        hits = written(hits if done is None else hits.join(done, ["task", "no"], "left_anti"), "anchor-hits")
        if hits.isEmpty():
            break
        found.append(hits)
        done = hits if done is None else written(done.union(hits), "anchor-done")
        known = given.join(hits, ["task", "no"]).groupBy("task", "value").agg(F.min("no").alias("since"))
    out = free
    for hits in found:
        out = out.union(hits)
    return out


def disconnected_strings(answers: DataFrame, calls: DataFrame, anchors: DataFrame, task: str, no: str, params: str, result: str, anchor: str, answer: str) -> DataFrame:
    """(task, value): text of a task's answer that its calls showed, but none that is connected with the anchor."""
    connected = written(connected_calls(calls, anchors, task, no, params, result, anchor), "anchor-connected").withColumn("_ok", F.lit(1))
    shown = calls.select(F.col(task).alias("task"), F.col(no).alias("no"), F.explode(F.array_distinct(J.string_leaves(F.col(result)))).alias("value"))
    shown = shown.join(connected, ["task", "no"], "left").groupBy("task", "value").agg(F.max("_ok").alias("ok"))
    said = answers.select(F.col(task).alias("task"), F.explode(F.array_distinct(J.string_leaves(F.col(answer)))).alias("value")).distinct()
    return said.join(shown.where("ok is null"), ["task", "value"], "left_semi").select(F.col("task").alias(task), "value")
