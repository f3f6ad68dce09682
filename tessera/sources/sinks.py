"""Sinks of runs: keyed upserts, appends with ids, and bundles committed in two phases.

Each takes a batch and its number, as foreachBatch gives them, and leaves the same table when a batch comes again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.sources.scratch import exists, file_system, written

#: Parts of an upserted table; a batch rewrites those that its keys fall into.
BUCKETS = 64
#: Columns that the sinks add.
BUCKET, BATCH, LOG_ID = "_bucket", "_batch", "log_id"


def _replace(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Puts df in place of the partitions that it has rows in, and of no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(batch: DataFrame, number: int, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> None:
    """Merges a batch into the table at path: of each key, the row that is last in `order` (nulls first) stays, among equal ones that of the later batch.

    Only buckets that the batch touches are read and rewritten. A key's rows are reduced before the shuffle. A batch that
    comes again, even after later ones, changes nothing.
    """
    spark = batch.sparkSession
    columns = batch.columns
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)
    new = batch.select(*columns, F.lit(number).cast("bigint").alias(BATCH), bucket)
    if exists(spark, path):
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        old = spark.read.schema(new.schema).parquet(path).where(F.col(BUCKET).isin(touched))
        new = new.unionByName(old)
    rest = [c for c in columns if c not in keys]
    rank = F.struct(*(F.col(o) for o in order), F.col(BATCH), *(F.to_json(F.struct(*rest)).alias("_rest") for _ in [0] if rest))
    last = new.groupBy(BUCKET, *keys).agg(F.max_by(F.struct(*rest, BATCH), rank).alias("_last"))
    _replace(last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}") for c in columns), F.col(f"_last.{BATCH}"), BUCKET).repartition(BUCKET), path, [BUCKET])


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET, BATCH)


def append(batch: DataFrame, number: int, path: str, order: Sequence[str]) -> None:
    """Appends a batch with log_id: 1, 2, 3, ... without gaps over all batches, by batch, then `order`.

    The batch is sorted into ranges; each starts where the ranges before it end, which takes one count for each range, and
    the batch where the batches before it end. Batches come in the order of their numbers; one that comes again takes
    its own place and ids, and rows that `order` does not tell apart may trade them.
    """
    spark = batch.sparkSession
    before = spark.read.schema(f"{BATCH} bigint").parquet(path).where(F.col(BATCH) < number).count() if exists(spark, path) else 0
    # the number of a row's range, and of the row in it
    placed = written(batch.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "append")
    part = F.shiftright("_at", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())  # one small row for each range
    starts, total = [], before + 1
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = spark.createDataFrame(starts, "_part bigint, _first bigint")
    out = placed.join(F.broadcast(first), part == F.col("_part"))  # as many rows as ranges
    ids = (F.col("_first") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).alias(LOG_ID)
    _replace(out.select(ids, *batch.columns, F.lit(number).cast("bigint").alias(BATCH)), path, [BATCH])


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BATCH)


def stream_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All there is now of a stream, batch by batch, into one of the sinks above."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CommitError(ValueError):
    """A bundle that is there already, or that fails its check."""


def commit_bundle(df: DataFrame, path: str, key: str, check: Callable[[DataFrame], str | None], write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Writes df as path/key in two phases: aside, then, if `check` finds no fault in what was written, by one rename.

    A key is committed once: a second commit is refused before anything is written, and of two at a time one rename
    fails. On any failure nothing is left of the attempt.
    """
    spark = df.sparkSession
    target, aside = f"{path.rstrip('/')}/{key}", f"{path.rstrip('/')}/_aside-{uuid.uuid4().hex}"
    if exists(spark, target):
        raise CommitError(f"{key} is committed already")
    fs, source = file_system(spark, aside)
    _, final = file_system(spark, target)
    try:
        (write or (lambda rows, to: rows.write.parquet(to)))(df, aside)
        fault = check(spark.read.parquet(aside))
        if fault:
            raise CommitError(fault)
        # a rename onto a folder that has come meanwhile would move into it
        if fs.exists(final) or not fs.rename(source, final):
            raise CommitError(f"{key} is committed already")
    finally:
        fs.delete(source, True)
    return target
