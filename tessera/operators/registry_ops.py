"""Tables of tasks and runs: latest rows, listings, coverage and its deficits, summaries, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, nulls first, as an upsert would leave."""
    last = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return last.select("_row.*")


def listing(df: DataFrame, limit: int, created: str, key: str, equal: dict | None = None) -> DataFrame:
    """Newest first; no rows for a limit of 0 or less."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return df.orderBy(F.col(created).desc_nulls_last(), F.col(key).desc()).limit(limit) if limit > 0 else df.limit(0)


def coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def deficits(groups: DataFrame, counts: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """What each group lacks of the target, the largest first."""
    out = groups.select(*keys).distinct().join(counts.select(*keys, "n"), list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("deficit", F.greatest(F.lit(0), F.lit(target) - F.col("n")).cast("bigint")).orderBy(F.desc("deficit"), *keys)


def run_summary(df: DataFrame, status: str, accepted: str, rejected: str) -> DataFrame:
    a, r = F.count_if(F.col(status) == accepted), F.count_if(F.col(status) == rejected)
    return df.agg(F.count("*").alias("total"), a.alias("accepted"), r.alias("rejected"), (F.count("*") - a - r).alias("other"))


def run_summaries(tasks: DataFrame, verifications: DataFrame, events: DataFrame, run: str, status: str, accepted: str, rejected: str) -> DataFrame:
    """run_summary() of every run that has tasks, with its numbers of verification results and of events."""
    a, r = F.count_if(F.col(status) == accepted), F.count_if(F.col(status) == rejected)
    out = tasks.groupBy(run).agg(F.count("*").alias("total"), a.alias("accepted"), r.alias("rejected"), (F.count("*") - a - r).alias("other"))
    for rows, name in ((verifications, "verification_results"), (events, "event_count")):
        counts = rows.groupBy(F.col(run).alias("_run")).agg(F.count("*").alias("_n"))
        out = out.join(counts, F.col(run).eqNullSafe(F.col("_run")), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_run", "_n")
    return out


def snapshot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage by group with the total of all groups beside it."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).orderBy(*keys)  # total is one row


def recent(df: DataFrame, keys: Sequence[str], limit: int, created: str, key: str, equal: dict | None = None) -> DataFrame:
    """The rest of a snapshot: the newest rows, each with the count of all rows of the same filter."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return listing(df, limit, created, key).select(*keys).crossJoin(F.broadcast(df.agg(F.count("*").alias("task_count"))))  # one row


def candidates(df: DataFrame, limit: int, created: str, key: str, topic: str, question: str, constraints: str, semantic: str, equal: dict | None = None) -> DataFrame:
    """The newest rows with the text that near-dedup compares: the registered one, or else topic, question and constraints, those that there are, a line each."""
    rows = listing(df, limit, created, key, equal)
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), text(c)) for n, c in (("topic", topic), ("question", question), ("constraints", constraints))))
    return rows.select(key, topic, F.coalesce(text(semantic), lines).alias("semantic_text"))


def unprocessed(items: DataFrame, done: DataFrame, item: str, key: str) -> DataFrame:
    """Items not in the set of processed keys."""
    return items.join(done.select(F.col(key).alias("_done")), F.col(item) == F.col("_done"), "left_anti")


def export(df: DataFrame, path: str, by: str, order: Sequence[str], where: Column | None = None) -> None:
    """Chosen records as Parquet by group, sorted within; fails if the target exists."""
    rows = df if where is None else df.where(where)
    rows.sortWithinPartitions(*order).write.mode("errorifexists").partitionBy(by).parquet(path)
