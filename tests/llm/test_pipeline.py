"""The corpus pipeline's stages against plain Python, each on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from tessera.llm.queries import tokenizer_path

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def made(spark):
    docs, out = spark.read.parquet(f"{ROOT}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, ROOT)
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = spark.createDataFrame(out[-1][2], after.schema)
    return {name: rest for name, *rest in out}


def test_columns(made):
    for name, (_, _, before, after) in made.items():
        assert name == "packing" or before == after


def test_quality(made):
    before, after, *_ = made["quality rules"]
    want = set()
    for r in before:
        w = WORD.findall(r.text)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + i for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for i in range(8)}
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w):
            want.add(r.doc_id)
    # the labelled rows of this table are too few to certify a cutoff
    assert {r.doc_id for r in after} == want


def test_near_dedup(made):
    before, after, *_ = made["near-dedup"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r.doc_id: WORD.findall(r.text.translate(lower)) for r in before}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in after} == {i for i in ids if top(i) == i}


def windows(rows, n=50):
    out = defaultdict(set)
    for r in rows:
        w = r.text.split()
        for k in range(len(w) - n + 1):
            out[tuple(w[k : k + n])].add(r.doc_id)
    return {k for k, v in out.items() if len(v) > 1}


def test_passages(made):
    before, after, *_ = made["substring dedup"]
    assert [r.doc_id for r in after] and {r.doc_id for r in before} == {r.doc_id for r in after}
    assert len(windows(after)) <= 0.02 * len(windows(before))
    shared = windows(before, 12)
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        w = r.text.split()
        if not any(tuple(w[k : k + 12]) in shared for k in range(len(w) - 11)):
            assert texts[r.doc_id] == r.text


def test_mixing(made, spark):
    before, after, *_ = made["mixing"]
    kept = Counter(r.doc_id for r in after)
    assert max(kept.values()) == 1 and set(kept) <= {r.doc_id for r in before}
    good = {r.doc_id for r in spark.read.parquet(f"{ROOT}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    mine = [r.doc_id for r in before if r.doc_id in good]
    assert sum(i in kept for i in mine) >= 0.97 * len(mine)


def test_packing(made):
    from tokenizers import Tokenizer

    before, after, *_ = made["packing"]
    t = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == want


def test_run(spark, made):
    assert corpus_pipeline.run(spark, ROOT).count() == len(made["packing"][1])
