"""Stages on documents whose ids are all null or all equal, and whose other columns have the names that operators use."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import neardup, passages

PROSE = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(12)]
SHARED = " ".join(f"shared{i}" for i in range(55))
NAMES = ("n_removed", "spans", "_found", "own_id", "own_key", "span_id", "span_key", "rep", "rep_key", "text_key", "node", "k1", "k2", "copies", "component", "component_id", "kept", "_row", "row", "r", "place", "n", "h", "t", "id", "size", "copy_of", "places", "lines", "rate", "p", "domain", "n_tokens", "labelled_id", "quality", "toxic", "start", "length", "x", "c", "least")


def documents(spark, ids):
    texts = [*PROSE, PROSE[0], PROSE[1].replace("w1x30", "other"), SHARED + "\n" + PROSE[2].replace("w2", "q"), SHARED + "\n" + PROSE[3].replace("w3", "z"), None, ""]
    rows = [(ids(k), t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in NAMES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.cache()


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("ids", [lambda k: k, lambda k: None, lambda k: 7], ids=["different", "null", "equal"])
def test_stages(spark, root, ids):
    docs = documents(spark, ids)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in NAMES), name
        if name == "near-dedup":  # an exact and a near copy go
            assert len(rows) == docs.count() - 2
        if name == "substring dedup":
            assert len(rows) == docs.count()
            again = sum(SHARED in (r.text or "") for r in rows)
            assert again == (1 if ids(1) == 1 else 2)  # rows of one id do not count against each other
    assert corpus_pipeline.packing(spark, docs, root).count() >= docs.count()


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7], ids=["null", "equal"])
def test_joins_do_not_multiply(spark, ids):
    """Sets are fetched once for each class, however many rows share its id."""
    docs = documents(spark, ids).select("doc_id", "text")
    every = neardup.signatures(docs, 5, 8, 4).where("n_shingles > 0")
    wanted = every.select(F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key"), "k1", "k2").distinct().withColumn("node", F.monotonically_increasing_id())
    from tessera.llm.storage import materialize

    wanted = materialize(wanted, "wanted")
    sets = neardup.full_sets(docs, wanted, 5, 32).collect()
    assert {r.node for r in sets} == {r.node for r in wanted.collect()} and len(sets) == docs.where("text <> ''").count()
    spans = passages.without_passages(documents(spark, lambda k: 1000 - k).select("doc_id", "text")).where("n_removed > 0")
    assert spans.count() == 3
