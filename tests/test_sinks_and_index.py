"""Sinks under replayed batches, bundles that fail half way, and the kept near-duplicate index against all pairs."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import dedup, near_index
from tessera.operators.near_index import NearIndex, decide
from tessera.sources import scratch, sinks


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.randrange(40), f"v{i}") for i in range(300)] + [(None, 1, "null key"), (None, 2, "later null key"), (7, None, "no order")]
    path = str(tmp_path / "t")
    batches = [spark.createDataFrame(rows[k::3], "k long, at long, v string") for k in range(3)]
    for n, b in enumerate(batches):
        sinks.upsert(b, n, path, ["k"], ["at"], buckets=8)
    best = {}
    for n in range(3):
        for k, at, v in rows[n::3]:
            order = (at is not None, at or 0, n)
            best.setdefault(k, (order, set()))
            if order > best[k][0]:
                best[k] = (order, {v})
            elif order == best[k][0]:
                best[k][1].add(v)
    read = lambda: {r.k: r.v for r in sinks.read_upserted(spark, path).collect()}
    once = read()
    assert set(once) == set(best) and all(once[k] in best[k][1] for k in best)
    sinks.upsert(batches[0], 0, path, ["k"], ["at"], buckets=8)
    assert read() == once
    before = files(path)
    sinks.upsert(spark.createDataFrame([(7, 99, "new")], "k long, at long, v string"), 3, path, ["k"], ["at"], buckets=8)
    after = files(path)
    touched = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(touched) == 1 and read() == once | {7: "new"}


def test_upsert_stream(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(k, n, f"{k}/{n}") for k in range(n, 6)], "k long, at long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = sinks.stream_into(stream, lambda b, n: sinks.upsert(b, n, out, ["k"], ["at"]), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert {r.k: r.v for r in sinks.read_upserted(spark, out).collect()} == {k: f"{k}/{min(k, 2)}" for k in range(6)}


def test_append(spark, tmp_path):
    path = str(tmp_path / "log")
    sizes = [50, 0, 33, 17]
    batches = [spark.range(s).select((F.col("id") + 1000 * n).alias("x")).repartition(5) for n, s in enumerate(sizes)]
    for n, b in enumerate(batches):
        sinks.append(b, n, path, ["x"])
    read = lambda: sorted((r.log_id, r.x) for r in sinks.read_appended(spark, path).collect())
    once = read()
    assert [i for i, _ in once] == list(range(1, 101)) and [x for _, x in once] == [1000 * n + k for n, s in enumerate(sizes) for k in range(s)]
    for n in (2, 0, 3):
        sinks.append(batches[n], n, path, ["x"])
    assert read() == once


def test_bundle(spark, tmp_path):
    root = str(tmp_path / "registry")
    df = spark.range(5)
    fine = lambda rows: None if rows.count() == 5 else "rows are missing"
    assert sinks.commit_bundle(df, root, "a", fine) == f"{root}/a"
    assert spark.read.parquet(f"{root}/a").count() == 5
    with pytest.raises(sinks.CommitError, match="already"):
        sinks.commit_bundle(df, root, "a", fine)
    with pytest.raises(sinks.CommitError, match="missing"):
        sinks.commit_bundle(df.limit(3), root, "b", fine)

    def fails(rows, to):
        rows.write.parquet(to)
        raise OSError("disk")

    with pytest.raises(OSError):
        sinks.commit_bundle(df, root, "c", fine, fails)

    def overtaken(rows):
        df.write.parquet(f"{root}/d")  # another commit of the key comes first

    with pytest.raises(sinks.CommitError, match="already"):
        sinks.commit_bundle(df, root, "d", overtaken)
    assert sorted(os.listdir(root)) == ["a", "d"]


def family(rng, n):
    out = []
    for f in range(n):
        base = [f"f{f}w{i}" for i in range(120)]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(120)] = f"x{rng.randrange(50)}"
            out.append(" ".join(w))
    out += ["", None, "two words", "Two  words", out[0], out[0]]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("verify", [True, False])
def test_near_index(spark, tmp_path, verify):
    rng = random.Random(4)
    texts = family(rng, 30)
    rows = [(i, t, "aaab"[i % 4] if i % 9 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, topic string").cache()
    # all pairs of one scope, by the same measure
    sets = dedup.shingled(df, "text").select("id", "topic", "shingle_hashes")
    value, measure = "shingle_hashes", dedup.jaccard
    if not verify:
        signed = dedup.signatures(sets, ["id"]).withColumnRenamed("id", "_i")
        sets, value, measure = sets.join(signed, F.col("id") == F.col("_i")), "minhash", dedup.slots_agreeing
    a, b = (sets.select(F.col("id").alias(f"{x}_id"), F.col("topic").alias(f"{x}_topic"), F.col(value).alias(x)) for x in "ab")
    pairs = a.join(b, F.col("a_topic").eqNullSafe(F.col("b_topic")) & (F.col("a_id") < F.col("b_id"))).select("a_id", "b_id", measure(F.col("a"), F.col("b")).alias("s")).where("s >= 0.9").collect()
    want = {}
    for p in sorted(pairs, key=lambda p: (-p.s, p.a_id)):
        want.setdefault(p.b_id, (p.a_id, round(p.s, 9)))
    assert len(want) > 15
    index, got = NearIndex(spark, str(tmp_path / "index"), "bigint", buckets=4), {}
    for n, (lo, hi) in enumerate(((0, 10), (10, 11), (11, len(rows)))):
        batch = df.where(F.col("id").between(lo, hi - 1))
        said = index.add(batch, n, "id", "id", "text", ["topic"], verify).collect()
        assert len(said) == hi - lo
        got |= {r.id: (r.match, round(r.similarity, 9)) for r in said if r.match is not None}
        if n == 0:  # the batch comes again
            again = index.add(batch, n, "id", "id", "text", ["topic"], verify).collect()
            assert sorted(map(str, again)) == sorted(map(str, said))
    assert got == want
    assert index.entries().groupBy("scope", "set1", "set2").count().where("count > 1").isEmpty()


def test_decide(spark):
    rng = random.Random(8)
    pairs = [(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(40)) if a < b] + [(40 + i, 41 + i) for i in range(9)]
    rows = spark.range(60).withColumnRenamed("id", "k")
    got = {r.k: r.kept for r in decide(rows, spark.createDataFrame(pairs, "a long, b long"), "k").collect()}
    kept = {}
    for k in range(60):
        kept[k] = not any(b == k and kept[a] for a, b in pairs)
    assert got == kept and not all(kept.values())


@pytest.fixture
def shared(tmp_path, monkeypatch):
    for module in (scratch, registry):
        monkeypatch.setattr(module, "scratch", lambda _, label: str(tmp_path / f"{label}-{uuid.uuid4().hex}"))
    return tmp_path


def test_sets_are_written_once_and_not_shuffled(spark, shared):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(200)]
    texts[150] = texts[3] + " more"
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    of_sets = sum(8 * (len(t.split()) - 2) for t in texts)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, index, said = shuffled(), NearIndex(spark, str(shared / "index"), "bigint", buckets=4), []
        for n in range(2):
            said += index.add(df.where(F.col("id").between(100 * n, 100 * n + 99)), n, "id", "id", "text").where("match is not null").collect()
        moved = shuffled() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.id, r.match) for r in said] == [(150, 3)]
    assert moved < of_sets / 2
    assert of_sets / 2 < sum(os.path.getsize(f) for f in files(shared)) < 1.5 * of_sets


def test_many_copies_and_shared_marks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = family(rng, 12) + ["one two three four"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").cache()
    got = []
    for few in (near_index.FEW, 3):
        monkeypatch.setattr(near_index, "FEW", few)
        index = NearIndex(spark, str(tmp_path / f"index{few}"), "bigint", buckets=4)
        got.append([sorted(map(str, index.add(df.where(F.col("id") % 2 == n), n, "id", "id", "text").collect())) for n in range(2)])
    assert got[0] == got[1] and sum("match=None" not in r for part in got[0] for r in part) > 15


def test_lookup_leaves_no_index(spark, shared):
    out = registry.near_dup_lookup(spark, "/root/testdata/sf0.001")
    assert not any(f.startswith(("near-index", "near-sets")) for f in os.listdir(shared))
    assert out.count() == 200
