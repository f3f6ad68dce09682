"""Passages that begin and end at any word, against all windows of plain Python."""

import random
from collections import defaultdict

import pytest

from tessera.llm import passages


def left(rows, n=50):
    """The windows of n words that two documents share."""
    seen = defaultdict(set)
    for i, text in rows:
        w = text.split()
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {k for k, v in seen.items() if len(v) > 1}


def new(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def wrap(words, width):
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def cleaned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in passages.without_passages(df).collect()}


@pytest.mark.parametrize("size", [50, 51, 60])
def test_every_passage_of_50_words(spark, size):
    rng = random.Random(size)
    texts, exact = [], []
    for _ in range(150):
        p = new(rng, size)
        for _ in range(2):
            texts.append(" ".join(new(rng, 30) + p + new(rng, 30)))
        exact += [0, size]
    got = cleaned(spark, texts)
    assert not left([(i, r.text) for i, r in got.items()])
    assert [got[i].n_removed for i in range(len(texts))] == exact


def test_other_line_breaks(spark):
    rng = random.Random(7)
    texts, size = [], []
    for n in (50, 100, 300):
        for one, two in ((12, 15), (12, 12), (8, 40)):
            p = new(rng, n)
            texts += [wrap(new(rng, 30) + p + new(rng, 30), one), wrap(new(rng, 35) + p + new(rng, 31), two)]
            size += [0, n]
    got = cleaned(spark, texts)
    # a block of 40 words that is 75 % alike goes whole, with up to 5 words beside the passage at either end
    assert all(n <= got[i].n_removed <= n + 10 * (n > 0) for i, n in enumerate(size))


def test_edited_short_lines(spark):
    """Runs of short lines, of which an edit leaves no 24 words in a row, or which are edited every 36 words; wrapped otherwise in the copy."""
    rng = random.Random(8)
    texts, least = [], []
    for n, edits in [(40, (20,))] * 12 + [(47, (23,))] * 12 + [(120, (30, 66, 102))] * 12:
        p = new(rng, n)
        q = [f"edit{rng.randrange(10**9)}" if k in edits else w for k, w in enumerate(p)]
        texts += ["\n".join([" ".join(new(rng, 25)), wrap(x, width), " ".join(new(rng, 25))]) for x, width in ((p, 8), (q, 11))]
        least += [0, 0.8 * n]
    got = cleaned(spark, texts)
    assert all(got[i].n_removed == 0 for i in range(0, len(texts), 2))
    assert sum(got[i].n_removed >= least[i] for i in range(1, len(texts), 2)) >= 0.95 * len(texts) / 2


def test_null_and_repeated_ids(spark):
    rng = random.Random(9)
    p, q = new(rng, 60), new(rng, 60)
    text = [" ".join(new(rng, 25) + p + new(rng, 25)) for _ in range(3)] + [" ".join(q)]
    rows = [(None, text[0]), (3, text[1]), (3, text[2]), (None, text[3]), (5, text[3]), (5, text[3])]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in passages.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 3, 0), (False, 3, 0), (False, 5, 0), (False, 5, 0), (True, 0, 60), (True, 0, 60)]


def test_texts_meet_marks_by_a_shuffle(spark):
    """However few the marks are: a plan that changes with the size would move more at scale than small tables show."""
    docs = spark.createDataFrame([(1, " ".join(new(random.Random(1), 30)))], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 5, [0])], "of_id long, of_key long, places array<int>")
    plan = passages.seeded_windows(docs, marks, least_run=24)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()


def test_shared_keys(spark):
    """Keys of two nodes or more, whose rows are shuffled once."""
    from tessera.llm import components

    rows = [(1, 5), (1, 3), (1, 9), (2, 4), (3, 7), (3, 7), (4, 2), (4, 1)]
    found = components.shared_keys(spark.createDataFrame(rows, "key long, node long"))
    assert sorted(map(tuple, found.collect())) == [(1, 3, 3), (1, 5, 3), (1, 9, 3), (4, 1, 1), (4, 2, 1)]
