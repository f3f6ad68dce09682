"""MinHash near-duplicates by min-max hashing.

Each permutation of the shingles' hashes gives two signature values, its minimum and its maximum, so half the hash
evaluations fill a signature, and each value agrees between two sets with probability equal to their Jaccard similarity.
Bands of values propose pairs; links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.components import link, shared_keys
from tessera.llm.storage import beside, discard, materialize, shield

SIGNATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def shingle_sets(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, of its words with A-Z in lower case; and where each text's start."""
    return W.distinct(*W.shingles(*W.word_hashes(blobs), width))


def least_agreement(percent: int, values: int) -> int:
    """How many of a sketch's bytes agree at least if the similarity is `percent`: 4.5 standard deviations below the mean."""
    s = percent / 100
    return max(1, int(values * s - 4.5 * (values * s * (1 - s)) ** 0.5))


def min_max(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """For nonempty sets, `count` signature values: the minimum and the maximum under each of count / 2 permutations."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(20240229))
    permutations = -(-count // 2)
    odd = rng.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32)
    out = np.empty((2 * permutations, len(starts) - 1), np.uint32)
    x = np.empty_like(low)
    for k in range(permutations):
        np.multiply(low, odd[k], out=x)
        x += add[k]
        out[2 * k], out[2 * k + 1] = np.minimum.reduceat(x, starts[:-1]), np.maximum.reduceat(x, starts[:-1])
    return out[:count]


def min_max_bands(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For nonempty sets, a matrix of band hashes; each band holds `rows` signature values."""
    signature = min_max(values, starts, bands * rows).astype(np.uint64)
    out = np.empty((signature.shape[1], bands), np.uint64)
    for band in range(bands):
        acc = np.full(signature.shape[1], np.uint64(band + 1))
        for v in signature[band * rows : (band + 1) * rows]:
            acc = W.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + v)
        out[:, band] = acc
    return out.view(np.int64)


def sketches(values: np.ndarray, starts: np.ndarray, count: int) -> list[bytes]:
    """For nonempty sets, the low bytes of `count` signature values."""
    return [x.tobytes() for x in (min_max(values, starts, count) & np.uint32(255)).astype(np.uint8).T]


def signatures(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a hash of the text, the set's size, its 128-bit fingerprint (k1, k2) and its band hashes (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            values, starts = shingle_sets(blobs, width)
            n = np.diff(starts)
            full = np.flatnonzero(n)
            digests = [xxhash.xxh3_128_intdigest(values[starts[d] : starts[d + 1]].tobytes()) for d in range(len(n))]
            found = min_max_bands(values, np.concatenate((starts[:-1][full], starts[-1:])), bands, rows) if len(full) else np.zeros((0, bands), np.int64)
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0))))
            k1, k2 = (np.array([x >> s & (1 << 64) - 1 for x in digests], np.uint64).view(np.int64) for s in (64, 0))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), batch.column(batch.schema.get_field_index("text_key")), pa.array(n), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.reshape(-1)))], names=SIGNATURES.names)

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, SIGNATURES)


def full_sets(documents: DataFrame, wanted: DataFrame, width: int, values: int) -> DataFrame:
    """(node, hashes, sketch) of the wanted classes (rep, rep_key, k1, k2, node), from one document of each, found by its doc_id and its text's hash."""
    own = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("rep_key"))
    chosen = documents.select("doc_id", "text").join(beside(wanted, 5, texts=True), own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            found, starts = shingle_sets(blobs, width)
            k1, k2, node = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "node"))
            keep, parts, signed = [], [], []
            for d in range(len(blobs)):
                own = found[starts[d] : starts[d + 1]]
                if xxhash.xxh3_128_intdigest(own.tobytes()) == (k1[d] % (1 << 64)) << 64 | k2[d] % (1 << 64):
                    keep.append(node[d])
                    parts.append(own.view(np.int64))
                    signed += sketches(own, np.array([0, len(own)]), values)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(signed, pa.binary())], names=SETS.names)

    return chosen.select("node", "k1", "k2", "text").mapInArrow(run, SETS)


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents of equal sets are one class, and classes are compared, never copies. A null or empty text, or one of white
    space, has an empty set and is linked with nothing: its component is its own doc_id. A text of fewer than `width`
    words is one shingle. Rows of null doc_id take part with their text; their component is the smallest doc_id reachable,
    null if there is none (kept is then true). Repeated rows each appear. An empty table gives no rows; other columns are
    ignored. At similarity `percent` the chance that no band of a pair agrees is (1 - s^rows)^bands: 5e-6 by default. Pairs
    inside a large key whose sketches agree in fewer than least_agreement() of their bytes are not confirmed, which a pair
    at `percent` meets once in 300,000 times.
    """
    values = bands * rows
    every = materialize(signatures(documents, width, bands, rows), "signatures")
    classes = every.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes.select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("rep_key"), "copies", "bands", "node"), "classes")
    shared = shared_keys(classes.select(F.explode("bands").alias("key"), "node"))
    nodes = materialize(shared.select(F.col("node").alias("n")).distinct(), "nodes")
    wanted = materialize(classes.join(beside(nodes, 1), F.col("node") == F.col("n"), "left_semi").select("rep", "rep_key", "k1", "k2", "node"), "wanted")
    sets = materialize(full_sets(documents, wanted, width, values), "sets")
    found = link(shared, sets.select("node", "sketch"), sets, percent, least_agreement(percent, values))
    discard(shared, nodes, wanted, sets)
    named = classes.select("k1", "k2", "rep", "copies", "node").join(beside(found).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep", "copies", F.col("component").isNotNull().alias("linked"), F.coalesce("component", "node").alias("component"))
    # a class of one document without links needs no name
    named = materialize(named.where("copies > 1 or linked"), "named")
    least = materialize(named.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("least")), "least")
    keepers = materialize(named.join(beside(least), F.col("component") == F.col("c")).select("c1", "c2", F.lit(True).alias("named"), "least"), "keepers")
    discard(classes, found, named, least)
    out = every.select("doc_id", "n_shingles", "k1", "k2").join(beside(keepers, 3), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("named"), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents, with all their columns, one for each component of near_duplicates().

    Rows are told apart by a number of their own, which is written with them, so null and repeated doc_ids neither join
    nor shadow each other. The row of the smallest doc_id stays (a null one comes last), of equal ones that of the least
    text hash. Rows of an empty set are linked with nothing and all stay.
    """
    inner, restore = shield(documents, ("doc_id", "text"))
    rows = materialize(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
    verdict = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("r"), "component_id")
    # only components of several rows lose any
    verdict = materialize(verdict, "verdict")
    several = materialize(verdict.groupBy(F.col("component_id").alias("c")).agg(F.count("*").alias("n")).where("n > 1").select("c"), "several")
    members = materialize(verdict.join(beside(several, 1), F.col("component_id") == F.col("c"), "left_semi"), "members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row").alias("place")
    placed = materialize(rows.select("_row", order).join(beside(members), F.col("_row") == F.col("r")).select("r", "component_id", "place"), "placed")
    first = materialize(placed.groupBy(F.col("component_id").alias("c")).agg(F.min("place")["_row"].alias("stays")), "first")
    gone = materialize(placed.join(beside(first), F.col("component_id") == F.col("c")).where("r <> stays").select("r"), "gone")
    discard(verdict, several, members, placed, first)
    return restore(rows.join(beside(gone, 1, texts=True), F.col("_row") == F.col("r"), "left_anti"))
