"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from tessera import registry

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations benchmark".split():
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    import re

    found = {(r.a, r.b) for r in registry.queries()["near_dup_verified"](spark, ROOT).collect()}
    docs = [(r.doc_id, r.lang, re.findall("[a-z0-9_]+", r.text.lower())) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    sets = [(i, lang, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)}) for i, lang, w in docs]
    least = {}
    for i, lang, s in sorted(sets, key=lambda x: x[0]):
        least.setdefault((lang, frozenset(s)), i)
    want = set()
    for i, lang, s in sets:
        rep = least[lang, frozenset(s)]
        if rep != i:
            want.add((rep, i))
    reps = [(i, lang, s) for i, lang, s in sets if least[lang, frozenset(s)] == i]
    for i, li, si in reps:
        for j, lj, sj in reps:
            if i < j and li == lj and len(si & sj) >= 0.9 * len(si | sj):
                want.add((i, j))
    assert found == want


def test_flagship(spark):
    assert registry.flagship(spark, ROOT).count() == 5
