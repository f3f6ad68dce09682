"""Signatures of sets of 64-bit hashes, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes permuted at a time, which stay in a core's cache.
BLOCK = 16_384
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mix(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The last steps of xxhash64, in place."""
    for shift, factor in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(x, np.uint64(shift), out=room)
        x ^= room
        if factor is not None:
            x *= factor
    return x


def least(values: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """The least of xxhash64(value, i), as Spark's function of a long and an int has it, for each run of values (a row; none of them empty) and each i (a column)."""
    out = np.empty((len(starts) - 1, permutations), np.int64)
    x = values.view(np.uint64)
    x = _turn(_turn(x * _P2, 31) * _P1 ^ (np.uint64(42) + _P5 + np.uint64(8)), 27) * _P1 + _P4
    turned = _turn(_mix(x, np.empty_like(x)) + _P5 + np.uint64(4), 23)
    marks = _turn(np.arange(permutations, dtype=np.uint64) * _P1, 23)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK, "right")) - 1)
        part = turned[starts[a] : starts[b]]
        got, room, at = np.empty_like(part), np.empty_like(part), starts[a:b] - starts[a]
        for i, mark in enumerate(marks):
            np.bitwise_xor(part, mark, out=got)
            np.multiply(got, _P2, out=got)
            np.add(got, _P3, out=got)
            out[a:b, i] = np.minimum.reduceat(_mix(got, room).view(np.int64), at)
        a = b
    return out


def bits(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """For each run of values a bitmap, as longs: bit v modulo its length is set for each value v. Its length is the least power of two that is twice the run's at least."""
    sizes = np.diff(starts)
    words = 1 << np.ceil(np.log2(np.maximum(sizes * 2 / 64, 1))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(ends[-1], np.uint64)
    at = values.view(np.uint64)
    word = (at >> np.uint64(6)).view(np.int64) & np.repeat(words - 1, sizes)
    np.bitwise_or.at(out, np.repeat(ends[:-1], sizes) + word, np.uint64(1) << (at & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.view(np.int64)))


def most_common(a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """How many values two sets have in common at most, by their bitmaps and sizes: what is set in the longer bitmap alone is a value of its set alone."""
    alone = lambda x, y: F.aggregate(F.transform(x, lambda w, i: F.bit_count(w.bitwiseAND(F.bitwise_not(F.get(y, i % F.size(y)))))), F.lit(0), lambda n, k: n + k)
    return F.least(F.when(F.size(a) >= F.size(b), a_size - alone(a, b)), F.when(F.size(b) >= F.size(a), b_size - alone(b, a)))


def with_signatures(rows: DataFrame, values: str, permutations: int, mapped: bool = False) -> DataFrame:
    """Adds minhash: the least of each permutation over the row's values, which are longs, at least one and none of them null; with mapped, also bits()."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ["minhash", "bits"][: 1 + mapped])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index(values))
            ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            got = least(flat, ends - ends[0], permutations)
            places = pa.array(np.arange(len(got) + 1, dtype=np.int32) * permutations)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(places, pa.array(got.reshape(-1))), *([bits(flat, ends - ends[0])] if mapped else [])], names=schema.names)

    return rows.mapInArrow(run, schema)
