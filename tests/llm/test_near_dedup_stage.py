"""The pipeline's near-dedup stage on null and repeated doc_ids."""

import corpus_pipeline

SCHEMA = "_row string, doc_id long, text string, lang string"


def prose(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def stage(spark, rows):
    df = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], SCHEMA)
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    return sorted(int(r["_row"]) for r in out.collect())


def test_null_ids(spark):
    a, b, c = prose("a"), prose("b"), prose("c")
    # a copy of document 1 under a null id goes, unique texts under null ids stay, and copies that all have null ids leave one
    rows = [(1, a, "en"), (None, a, "en"), (None, b, "en"), (None, c, "en"), (None, c + " end", "en"), (None, c, "en")]
    got = stage(spark, rows)
    assert got[:2] == [0, 2] and len(got) == 3 and got[2] in (3, 4, 5)


def test_repeated_ids(spark):
    a, b, c = prose("a"), prose("b"), prose("c")
    # row 2 is a near copy of document 1 and shares its id with row 3, which is clean; rows 4 to 6 are copies under one id
    got = stage(spark, [(1, a, "en"), (2, b, "en"), (5, a + " end", "en"), (5, c, "en"), (7, b, "en"), (8, prose("d"), "en"), (8, prose("d"), "en"), (8, prose("d") + " end", "en")])
    assert got[:3] == [0, 1, 3] and len(got) == 4 and got[3] in (5, 6, 7)


def test_empty_texts_stay(spark):
    assert stage(spark, [(1, "", "en"), (1, None, "en"), (None, " ", "en"), (None, "", "en")]) == [0, 1, 2, 3]
