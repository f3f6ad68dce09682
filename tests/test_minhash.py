"""Signatures against Spark's own hash, and near duplicates that read their texts once."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import minhash
from tessera.operators import dedup

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_least_is_the_least_of_sparks_hash(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    lists = [[0], [-1, 5, 2**62], list(range(40)), [-(2**63), 2**63 - 1]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<long>")
    want = df.orderBy("i").select(F.array(*(F.expr(f"array_min(transform(h, x -> xxhash64(x, {k})))") for k in range(9))).alias("m")).collect()
    starts = np.cumsum([0, *map(len, lists)])
    assert minhash.least(np.concatenate([np.array(x, np.int64) for x in lists]), starts, 9).tolist() == [r.m for r in want]


def test_texts_are_read_once(spark):
    docs = spark.read.parquet(DOCS)
    for verify in (True, False):
        pairs = dedup.near_pairs(docs, "doc_id", "text", ["lang"], verify=verify)
        assert pairs.count() and not any(f.endswith("documents.parquet") for f in pairs.inputFiles())


def test_shingles_of_few_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" ?! ",), ("One",), ("a  B",), ("a b a b a",)], "t string")
    assert [r.s for r in df.select(dedup.shingles(F.col("t")).alias("s")).collect()] == [[], [], ["?!"], ["one"], ["a b"], ["a b a", "b a b"]]
    assert [len(r.shingle_hashes) for r in dedup.shingled(df, "t").collect()] == [1, 1, 1, 2]


def test_bitmaps_bound_what_sets_share(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**63), 2**63 - 1, 1400)
    lists = [[int(x) for x in rng.choice(pool, n, replace=False)] for n in (1, 2, 30, 33, 250, 260, 500, 520, 1000)]
    lists += [[*lists[7][:-3], 5, 6, 7], [*lists[7], *range(90)], lists[4]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<long>")
    mapped = minhash.with_signatures(df, "h", 2, mapped=True).select("i", F.size("h").alias("n"), "bits")
    a, b = mapped.toDF("i", "n", "x"), mapped.toDF("j", "m", "y")
    got = {(r.i, r.j): r.most for r in a.crossJoin(b).select("i", "j", minhash.most_common(F.col("x"), F.col("y"), F.col("n"), F.col("m")).alias("most")).collect()}
    for (i, j), most in got.items():
        shared = len(set(lists[i]) & set(lists[j]))
        assert shared <= most <= max(len(lists[i]), len(lists[j]))
    # copies reach their size; others of like size are told apart
    assert got[4, 4] == got[4, 11] == 250 and max(got[4, 5], got[5, 4]) < 200 and max(got[6, 7], got[7, 6]) < 420
