"""States of flows over their whole history: what a circuit breaker or a backoff had come to at every event.

A history is an ordered run of small steps, each a function from the state before it to the state after it. Functions of
neighbouring steps compose, so that a key's history is cut into chunks of time, each chunk is summed up on its own, and
chunks are put in order by one short window over their sums. No task gets more than a chunk of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import written

#: Segments of one run that are put in order in one row.
BLOCK = 512


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def carried(rows: DataFrame, key: str, chunk: str, order: Sequence[str], last: Mapping[str, Column], inclusive: bool = True, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds to each row the last non-null value of each of `last`, and the sum of each of `sums`, over the key's rows up to it; not inclusive: up to the one before it.

    Chunks ascend with `order` within a key. The composed form of a chunk is its last values and its sums.
    """
    sums = sums or {}
    names = [*last, *sums]
    rows = rows.select("*", *(c.alias(f"_v_{n}") for n, c in (last | sums).items()))
    within = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    place = F.struct(*order)
    whole = rows.groupBy(F.col(key).alias("_key"), F.col(chunk).alias("_chunk")).agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_w_{n}") for n in last), *(F.sum(f"_v_{n}").alias(f"_w_{n}") for n in sums))
    earlier = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_key", "_chunk", *(F.last(f"_w_{n}", True).over(earlier).alias(f"_b_{n}") for n in last), *(F.coalesce(F.sum(f"_w_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = rows.select("*", *(F.last(f"_v_{n}", True).over(within).alias(f"_o_{n}") for n in last), *(F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)).alias(f"_o_{n}") for n in sums))
    out = own.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col(chunk) == F.col("_chunk")))
    out = out.select("*", *(F.coalesce(f"_o_{n}", f"_b_{n}").alias(n) for n in last), *((F.col(f"_o_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))
    return out.drop("_key", "_chunk", *(f"_{p}_{n}" for n in names for p in "vob"))


def chunk_of(df: DataFrame, column: str) -> Column:
    """A number that ascends with a column, for chunks: days of a time, thousands of a number, and one chunk for all of another kind. Nulls come first."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        whole = F.floor(micros(column) / F.lit(86_400_000_000))
    elif isinstance(kind, T.NumericType):
        whole = F.floor(F.col(column) / F.lit(1000))
    else:
        whole = F.lit(0)
    return F.coalesce(whole.cast("bigint"), F.lit(-(2**62)))


def trailing(rows: DataFrame, key: str, t: str, tie: str, width: int, counts: Mapping[str, Column], peers: bool = False) -> DataFrame:
    """Adds, for each condition, how many rows of the key it held for among those up to this one, in the order of (t, tie), that are at most `width` older; with peers, all rows of its own t count. t is a whole number, or null, which is older than all and of which nulls alone are in reach.

    A row is seen in its own stretch of `width` and, to count only, in the next one.
    """
    rows = rows.select("*", *(F.when(c, 1).otherwise(0).alias(f"_c_{n}") for n, c in counts.items()))
    stretches = F.when(F.col(t).isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    seen = rows.withColumn("_later", F.explode(stretches)).withColumn("_stretch", F.floor(F.col(t) / F.lit(width)) + F.col("_later"))
    by = Window.partitionBy(key, "_stretch")
    upto = by.orderBy(t).rangeBetween(Window.unboundedPreceding, 0) if peers else by.orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    gone = by.orderBy(t).rangeBetween(Window.unboundedPreceding, -width - 1)
    left = lambda n: F.when(F.col(t).isNotNull(), F.coalesce(F.sum(f"_c_{n}").over(gone), F.lit(0))).otherwise(0)
    out = seen.select("*", *((F.sum(f"_c_{n}").over(upto) - left(n)).alias(n) for n in counts))
    return out.where("_later = 0").drop("_later", "_stretch", *(f"_c_{n}" for n in counts))


def breaker_states(events: DataFrame, key: str, ts: str, tie: str, failed: Column, seconds: float, least: int, rate: float, probe: float, forced: Column | None = None, cooldown: Column | None = None) -> DataFrame:
    """Adds n, errors, error_rate, state, available and cooldown_remaining_s of a circuit breaker after each event of its key.

    A failure opens it for `probe` seconds if the last `seconds` hold `least` events, this one included, and the share of
    failures reaches `rate`. Until a success after that time closes it, it is in probe. `forced` events open it for
    `cooldown` seconds (else `probe`) and count as no request. Events are ordered by ts, then tie, which does not repeat;
    those without a ts are left out; a null outcome is a success. The state of a history is the last opening and the last
    success, so that chunks compose by taking the later of each.
    """
    force = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    width = int(seconds * 1_000_000)
    rows = events.where(F.col(ts).isNotNull()).select("*", micros(ts).alias("_t"), F.coalesce(failed, F.lit(False)).alias("_bad"), force.alias("_force"), (cooldown if cooldown is not None else F.lit(None)).cast("double").alias("_cool"))
    rows = trailing(rows, key, "_t", tie, width, {"n": ~F.col("_force"), "errors": F.col("_bad") & ~F.col("_force")})
    trips = ~F.col("_force") & F.col("_bad") & (F.col("n") >= least) & (F.col("errors") / F.nullif(F.col("n"), F.lit(0)) >= rate)
    span = lambda s: (s * 1_000_000).cast("bigint")
    until = F.when(F.col("_force"), F.col("_t") + span(F.coalesce("_cool", F.lit(float(probe))))).when(trips, F.col("_t") + span(F.lit(float(probe))))
    place = F.struct(F.col("_t").alias("t"), F.col(tie).alias("tie"))
    opened = F.when(until.isNotNull(), F.struct(place.alias("at"), until.alias("until")))
    success = F.when(~F.col("_force") & ~F.col("_bad"), place)
    rows = carried(rows.withColumn("_chunk_of", F.floor(F.col("_t") / F.lit(width))), key, "_chunk_of", ["_t", tie], {"_open": opened, "_well": success})
    closed = F.col("_open").isNull() | F.coalesce((F.col("_well") > F.col("_open.at")) & (F.col("_well.t") >= F.col("_open.until")), F.lit(False))
    waiting = ~closed & (F.col("_t") < F.col("_open.until"))
    out = rows.select(
        *events.columns,
        "n",
        "errors",
        F.coalesce(F.col("errors") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("error_rate"),
        F.when(closed, "closed").when(waiting, "open").otherwise("probe").alias("state"),
        (~waiting).alias("available"),
        F.when(waiting, (F.col("_open.until") - F.col("_t")) / 1_000_000).otherwise(0.0).alias("cooldown_remaining_s"),
    )
    return out


def backoff_states(events: DataFrame, key: str, ts: str, tie: str, discarded: Column, limit: int, seconds: float) -> DataFrame:
    """Adds discards (in a row) and backoff_until (seconds of the epoch, or null) of each event's key after it.

    From `limit` discards in a row on, each backs its key off for `seconds`. A success starts anew, and so does the first
    event at or after the end of a backoff. Events are ordered by ts, then tie, which does not repeat; those without a ts
    are left out; a null outcome is a success.

    Discards without a success or a gap of `seconds` between them are a segment, in which the count just goes on. A gap
    takes it to 0 if it has reached the limit. So a row of segments is a function on the counts below the limit: a table
    of `limit` numbers, and tables compose.
    """
    width = int(seconds * 1_000_000)
    rows = events.where(F.col(ts).isNotNull()).select("*", micros(ts).alias("_t"), F.coalesce(discarded, F.lit(False)).alias("_bad"))
    rows = rows.withColumn("_chunk_of", F.floor(F.col("_t") / F.lit(max(1, width))))
    order = ["_t", tie]
    rows = carried(rows, key, "_chunk_of", order, {"_prev": F.struct("_t", "_bad")}, inclusive=False)
    goes_on = F.coalesce(F.col("_prev._bad"), F.lit(False))
    run = F.col("_bad") & ~goes_on
    segment = F.col("_bad") & (~goes_on | (F.col("_t") - F.col("_prev._t") >= width))
    rows = rows.withColumn("_is_run", run).withColumn("_is_segment", segment)
    rows = carried(rows, key, "_chunk_of", order, {}, sums={"_i": F.col("_bad").cast("int")})
    rows = carried(rows, key, "_chunk_of", order, {"_run": F.when(F.col("_is_run"), F.col("_i")), "_segment": F.when(F.col("_is_segment"), F.col("_i"))})
    rows = written(rows, "backoff")
    bad = rows.where("_bad")
    # runs of more than one segment need their segments' entry counts; all others start from 0
    segments = bad.groupBy(key, "_run", "_segment").agg((F.max("_i") - F.col("_segment") + 1).alias("m"))
    many = written(segments.groupBy(key, "_run").agg(F.count("*").alias("_n")).where("_n > 1"), "backoff-runs").select(F.col(key).alias("_k"), F.col("_run").alias("_r"))
    in_run = segments.join(many, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_run") == F.col("_r"))).drop("_k", "_r")
    entries = _entry_counts(in_run, key, limit).select(F.col(key).alias("_k"), F.col("_segment").alias("_s"), "entry")
    out = rows.join(entries, F.col("_bad") & F.col(key).eqNullSafe(F.col("_k")) & (F.col("_segment") == F.col("_s")), "left")
    count = F.when(F.col("_bad"), F.coalesce("entry", F.lit(0)) + F.col("_i") - F.col("_segment") + 1).otherwise(0)
    out = out.withColumn("discards", count.cast("bigint"))
    return out.select(*events.columns, "discards", F.when(F.col("discards") >= limit, (F.col("_t") + width) / 1_000_000).alias("backoff_until"))


def _after(count: Column, m: Column, limit: int) -> Column:
    return F.when(count + m >= limit, F.lit(0).cast("bigint")).otherwise(count + m)


def _scan(lengths: Column, start: Column, limit: int) -> Column:
    """The count at the entry of each segment, and, last, after all."""
    return F.aggregate(lengths, F.array(start), lambda got, m: F.concat(got, F.array(_after(F.element_at(got, -1), m, limit))))


def _entry_counts(segments: DataFrame, key: str, limit: int) -> DataFrame:
    """Adds entry to segments (key, _run, _segment, m). Segments of a run are numbered and taken block by block; a block is a table of `limit` counts."""
    # numbers within a run: segments start at ascending places, so that ranges of these are chunks
    ranges = segments.withColumn("_range", F.floor(F.col("_segment") / 4096)).withColumn("_of", F.struct(F.col(key).alias("k"), F.col("_run").alias("r")))
    placed = carried(ranges, "_of", "_range", ["_segment"], {}, sums={"_place": F.lit(1)})
    blocks = placed.groupBy(key, "_run", F.floor((F.col("_place") - 1) / BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_segment", "m"))).alias("x"))
    counts = F.sequence(F.lit(0).cast("bigint"), F.lit(limit - 1).cast("bigint"))
    lengths = F.transform("x", lambda s: s["m"].cast("bigint"))
    blocks = written(blocks.withColumn("_lengths", lengths).withColumn("_table", F.transform(counts, lambda c: F.aggregate("_lengths", c, lambda got, m: _after(got, m, limit)))), "backoff-blocks")
    # a run's blocks, one short row each, give the count at the entry of each
    runs = blocks.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("_block", "_table"))).alias("t"))
    starts = F.aggregate("t", F.array(F.lit(0).cast("bigint")), lambda got, b: F.concat(got, F.array(F.element_at(b["_table"], (F.element_at(got, -1) + 1).cast("int")))))
    at = runs.select(F.col(key).alias("_k"), F.col("_run").alias("_r"), F.posexplode(starts).alias("_b", "_start"))
    joined = blocks.join(at, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_run") == F.col("_r")) & (F.col("_block") == F.col("_b")))
    entered = F.arrays_zip(F.transform("x", lambda s: s["_segment"]).alias("s"), F.slice(_scan(F.col("_lengths"), F.col("_start"), limit), 1, F.size("x")).alias("e"))
    return joined.select(key, F.explode(entered).alias("z")).select(key, F.col("z.s").alias("_segment"), F.col("z.e").alias("entry"))
