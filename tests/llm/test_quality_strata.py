"""Cutoffs in force: what they promise, on labels drawn from known distributions and on a table."""

import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality

RULES = list(quality.RULES)


def draw(rng, good, bad, noise):
    """Levels and counts of labelled texts: bad ones have high levels of one of two rules, good ones seldom any."""
    n = good + bad
    levels = np.zeros((n, len(RULES)), int)
    is_good = np.arange(n) < good
    for j in range(len(RULES)):
        levels[:, j] = np.where(rng.random(n) < noise, rng.integers(1, 12, n), 0)
    which = rng.choice([0, 4], n)
    hit = ~is_good & (rng.random(n) < 0.8)
    levels[hit, which[hit]] = rng.integers(5, 12, int(hit.sum()))
    return levels, is_good


def test_few_labels_certify_and_the_risk_holds():
    """Over many draws, a region that rejects more than the risk of all good texts is certified at most delta of the time."""
    rng = np.random.default_rng(5)
    risk, delta, broken, on = 0.05, 0.1, 0, 0
    for _ in range(300):
        noise = rng.choice([0.0, 0.004, 0.008, 0.02])
        (tl, tg), (hl, hg), (xl, xg) = draw(rng, 120, 40, noise), draw(rng, 120, 40, noise), draw(rng, 20_000, 10, noise)
        cut = quality.certify(quality.path(tl, tg.astype(int), (~tg).astype(int)), hl, hg.astype(int), risk, delta)
        on += any(np.isfinite(cut))
        rejected = np.zeros(len(xl), bool)
        for j, (c, grid) in enumerate(zip(cut, quality.RULES.values(), strict=True)):
            if np.isfinite(c):
                rejected |= xl[:, j] >= grid.index(c) + 1
        broken += rejected[xg].mean() > risk
    assert broken <= delta * 300 and on > 150


def test_path_prefers_what_rejects_only_bad():
    levels = np.array([[0] * 8, [3] + [0] * 7, [0, 7] + [0] * 6, [0, 2] + [0] * 6])
    steps = quality.path(levels, np.array([100, 0, 1, 30]), np.array([0, 20, 10, 5]))
    assert steps == [(0, 3), (1, 7)]
    assert quality.certify(steps, levels, np.array([300, 0, 2, 9]), 0.05, 0.05)[:2] == [list(quality.RULES.values())[0][2], list(quality.RULES.values())[1][6]]
    assert quality.certify(steps, levels, np.array([30, 0, 2, 9]), 0.05, 0.05) == [np.inf] * 8


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1400):
        lang, bad = ("en", "de", None)[i % 3 if i < 1380 else 1], i % 5 == 0
        words = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
        if bad:
            words[::3] = ["$$##"] * len(words[::3])
        rows.append((i, " ".join(words), lang if i < 1390 else "xx"))
        if i % 7:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(5000 + i, rows[1][1], "xx") for i in range(300)]
    labels += [(5000 + i, 1, 0) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_strata_stand_alone(spark, tables):
    docs, labels = tables
    got = quality.verdicts(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    # each stratum with labels enough rejects its junk, labelled or not, and no good text
    assert all(by[i].kept == (i % 5 != 0) for i in range(1380))
    # 300 copies of one text are one label, so nothing is certified for the language of few
    assert all(by[i].kept for i in range(1390, 1400)) and by[5000].kept
    assert all(r.rules == ["symbols_per_word"] for i, r in by.items() if i < 1380 and i % 5 == 0)
    kept = quality.keep_documents(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in by.items() if r.kept)


def test_counts_against_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in quality.verdicts(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    for r in rows.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + i for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for i in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), len(again))
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.kept == (not x.base_failed) == (len(w) >= 20 and 100 * len(again) <= 30 * len(w))
