"""Sharding by rendezvous hashing of stable keys over weighted shards.

For each shard a record draws u from a hash of its key and the shard's number, and goes to the shard with the least
-ln(u) / weight. A shard's draw does not depend on the other shards: with one more shard, a record either stays or
moves into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the keys' hash within which slots are counted: 3 hex digits of md5.
SLOT_RANGES = 4096


def _draw(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (from 0) for a key. weights: of each shard, all above 0. A null key counts as the empty one."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = [_draw(text, k, w) for k, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def with_slots(df: DataFrame, shard: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds slot: each row's place in its shard, gapless from 0, by the range of the keys' md5, then `order`.

    Rows of a shard are numbered within SLOT_RANGES ranges of the keys' hash, and each range starts where the ranges
    before it end; the table of ranges has SLOT_RANGES rows a shard whatever the input's size. So no task gets a whole shard.
    """
    part = F.substring(F.md5(F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))), 1, 3)
    rows = df.withColumn("_range", part)
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(shard, "_range").agg(F.count("*").alias("_n")).select(F.col(shard).alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_range").orderBy(*order)
    out = rows.withColumn("_place", F.row_number().over(within) - 1)
    joined = out.join(F.broadcast(first), (out[shard] == first["_s"]) & (out["_range"] == first["_r"]))
    return joined.withColumn("slot", (F.col("_first") + F.col("_place")).cast("long")).drop("_range", "_place", "_first", "_s", "_r")


def shard_documents(documents: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law `key`.

    grown_shard is the shard with one more of grown_weight. A null text has size 8 and the checksum of no bytes; a null
    doc_id is an ordinary key; rows that share a doc_id share a shard and get slots of their own; an empty table gives
    an empty result; other columns are ignored.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = documents.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    out = with_slots(rows, "shard", ["doc_id", "text_crc32"], ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
