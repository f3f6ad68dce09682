"""Operators against plain Python on small inputs."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from tessera.llm import components, lm, mixing, neardup, quality, vptree
from tessera.llm import words as W

ROOT = "/root/testdata/sf0.001"


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, one_task):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)]
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components.components(df, one_task).collect()}
    assert got == union_find(pairs, {x for p in pairs for x in p})


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_of_a_large_family(spark):
    """A group in which many pairs lie on either side of the threshold."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    texts = family(rng, base, 150, 9) + [" ".join(f"o{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = union_find(pairs, range(len(sets)))
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_min_max_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = [np.sort(a[:500]), np.sort(a[100:])]
    values = neardup.min_max(np.concatenate(sets), np.array([0, 500, 1000]), 512)
    assert abs((values[:, 0] == values[:, 1]).mean() - 400 / 600) < 0.08
    bands = neardup.min_max_bands(np.concatenate(sets), np.array([0, 500, 1000]), 128, 4)
    assert abs((bands[0] == bands[1]).mean() - (400 / 600) ** 4) < 0.12


def nearest_of(rows, queries, k):
    """(query, rank): (id, score), by plain sorting."""
    out = {}
    for i, q in rows:
        if i in queries:
            found = sorted((-float(np.dot(q, x)), j) for j, x in rows if j != i)[:k]
            out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("shard", [16_384, 150])
def test_exact_search_on_ties(spark, shard, monkeypatch):
    """Factor one against brute force, on integer vectors full of ties and copies, in one shard and in several."""
    monkeypatch.setattr(vptree, "SHARD_ROWS", shard)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (1200, 4)).astype(float)
    x[100:400] = x[5]
    x[700:900, 0] = 2  # many different vectors of equal products with an axis
    x[0], x[20] = [1, 0, 0, 0], [3, 0, 0, 0]
    rows = [(int(i), v) for i, v in zip(rng.permutation(1200), x, strict=True) if v.any()]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    queries = {i for i, _ in rows if i % 20 == 0} | {rows[0][0], rows[20][0]}
    got = vptree.nearest(df, df.where(df.vec_id.isin(sorted(queries))), 20, 1.0).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == nearest_of(rows, queries, 20)


@pytest.mark.parametrize("shard", [16_384, 200])
def test_exact_search_on_reals(spark, shard, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", shard)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 8)) * rng.uniform(0.2, 2, (1500, 1))
    rows = list(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vptree.nearest(df, df.where("vec_id % 30 = 0"), 10, 1.0).collect()}
    assert got == {p: i for p, (i, _) in nearest_of(rows, set(range(0, 1500, 30)), 10).items()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1", "gaussian", "unit", "clusters", "lengths"])
def test_recall(spark, size):
    """At the factor that is chosen by a trial, on the given tables and on vectors of other kinds."""
    rng = np.random.default_rng(9)
    made = {"gaussian": lambda: rng.standard_normal((20_000, 32)), "unit": lambda: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.standard_normal((20_000, 64))), "clusters": lambda: rng.standard_normal((400, 64))[rng.integers(0, 400, 20_000)] + 0.3 * rng.standard_normal((20_000, 64)), "lengths": lambda: rng.standard_normal((20_000, 16)) * rng.lognormal(0, 0.7, (20_000, 1))}
    if size in made:
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": list(made[size]().astype(np.float32))})).where("vec_id % 20 <> 0 or vec_id % 100 = 0").cache()
    else:
        df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    hits, got = 0, {}
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.95 * 20 * len(got)


def test_upper_bounds():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    p = quality.upper_bound(3, 50, 0.01)
    from math import comb

    assert sum(comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.01, rel=1e-6)


@pytest.mark.parametrize("weights", [(0.9, 0.05, 0.05), (0.5, 0.3, 0.2), (0.98, 0.01, 0.01)])
def test_rates_meet_the_targets(spark, weights):
    """Against the same least squares in numpy, and against the targets themselves."""
    rng = np.random.default_rng(6)
    n = rng.integers(1, 900, 600)
    p = rng.dirichlet((0.3, 0.05, 0.04), 600)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    steps, target, reached = mixing.solve(rows, list(weights))
    totals = (p * n[:, None]).sum(0)
    assert np.allclose(target, totals[0] * np.array(weights) / weights[0])
    rate = mixing.replay(p, steps)
    assert (rate >= 0).all() and np.allclose((p * (n * rate)[:, None]).sum(0), reached)
    assert np.abs(reached - target).max() <= 1e-4 * n.sum()
    # projected gradient by dense matrices, in the metric of the tokens
    a, x = (p * n[:, None]).T, np.ones(600)
    for _ in steps:
        free = x > 0
        gram = (p[free] * n[free, None]).T @ p[free]
        scale = np.diag(1 / np.diag(gram))
        length = 1 / np.linalg.eigvals(scale @ gram).real.max()
        x = np.maximum(x - length * (a.T @ scale @ (a @ x - target)) / n, 0)
    assert np.allclose(x, rate)


def test_unreachable_targets_leave_the_least_residual(spark):
    rows = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.5, 0.5])], "n_tokens long, p array<double>")
    steps, target, reached = mixing.solve(rows, [0.9, 0.1])
    assert np.allclose(target, [15, 15 / 9]) and np.abs(reached - target).max() < np.abs(np.array([15, 15]) - target).max() and reached[0] == pytest.approx(reached[1])


def test_probabilities_are_calibrated(spark):
    """Few documents of one domain, and evidence that overstates: mean probabilities are the shares all the same."""
    rng = np.random.default_rng(8)
    domain = rng.choice(3, 6000, p=(0.9, 0.01, 0.09))
    logs = rng.normal(0, 30, (6000, 3))
    logs[np.arange(6000), domain] += 60 * (domain != 1)
    model = mixing.Classifier(np.zeros((3, mixing.PLACES)), np.array([5.0, 5.0, 5.0]))
    model.calibrate(logs[:3000], domain[:3000])
    p = model._softmax(model._inputs(logs[3000:]) @ model.logistic.T)
    assert np.allclose(p.mean(0), np.bincount(domain[3000:], minlength=3) / 3000, atol=0.015)
    assert (p.argmax(1) == domain[3000:]).mean() > 0.95


def test_classifier_on_held_out_labels(spark):
    """Learned from two thirds of the labels, held against the others. The table has some 300 toxic documents to learn from, and half of the others are told; with five times as many rows it was four fifths."""
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = mixing.memberships(docs, model, ["doc_id"]).join(mixing.labelled(labels.where("doc_id % 3 = 0")).withColumnRenamed("labelled_id", "doc_id"), "doc_id").collect()
    clean = [r for r in rows if r.domain == 0]
    junk = [r for r in rows if r.domain == 1]
    toxic = [r for r in rows if r.domain == 2]
    assert sum(r.p[0] > 0.5 for r in clean) >= 0.97 * len(clean) and sum(r.p[1] > 0.5 for r in junk) >= 0.7 * len(junk) and sum(r.p[2] > 0.5 for r in toxic) >= 0.5 * len(toxic)


def test_places_of_whole_words():
    one, two = b"a" + b"-a" * 40, b"a" + b"-a" * 39 + b"-9"
    _, shapes = mixing._places([one, two, b"aaab", b"ab"])
    assert shapes[0] != shapes[1] and shapes[2] == shapes[3]


def test_shingles_of_words():
    t = W.WordTable(W.hash64)
    rows, starts = W.split(t, [b"a b c d e f", b"a b c d e", b"", b"a b"])
    values, at = W.shingles(t.columns[0][rows], starts, 5)
    assert np.diff(at).tolist() == [2, 1, 0, 1] and values[0] == values[2] != values[1]


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abAB \n\t.\xc3\xa9") for _ in range(rng.randrange(200))) for _ in range(300)] + [b"", b" ", b"x" * 5000 + b" Y", b"\x0b\x0c", b"\x00 \x00\x00"]
    for segment in (1 << 18, 64):
        monkeypatch.setattr(W, "SEGMENT", segment)
        W._powers.clear()
        hashes, starts = W.word_hashes(texts)
        words = [w.lower() for t in texts for w in t.split()]
        assert np.diff(starts).tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
        by = dict(zip(words, hashes.tolist(), strict=True))
        assert all(by[w] == h for w, h in zip(words, hashes.tolist(), strict=True)) and len(set(by.values())) == len(by)
    W._powers.clear()
    many = [f"{i:x}" for i in range(400_000)] + ["ab" * k for k in range(1, 60)] + ["ba" * k for k in range(1, 60)]
    assert len(set(W.word_hashes([" ".join(many).encode()])[0].tolist())) == len(set(many))


def test_word_table_forgets():
    t = W.WordTable(W.hash64, limit=4)
    for text in (b"a a b b c d e", b"e a f g h", b"a", b"b b z z y x w v u t", b"z"):
        rows, _ = W.split(t, [text])
        assert t.columns[0][rows].tolist() == W.hash64(text.split())[0].tolist()
    assert len(t) <= 4 and b"z" in t and b"w" not in t


def test_word_table_holds_numbers_only():
    """A word costs its slots, hash and columns, and no object of its own."""
    import tracemalloc

    words = b" ".join(b"%x-word-of-some-length" % (k * 7919) for k in range(100_000))
    W.split(W.WordTable(W.hash64), [words])
    t = W.WordTable(W.hash64)
    tracemalloc.start()
    rows, _ = W.split(t, [words])
    rows, held = len(set(rows.tolist())), tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert rows == 100_000 and held < 140 * 100_000


def test_word_table_tells_words_apart():
    """Words of all sizes, some with zero bytes, those that share long parts, and those beyond the size that is read by eights."""
    rng = random.Random(3)
    words = [b"a" * k for k in range(1, 150)] + [b"\x00" * k for k in range(1, 70)] + [b"x" * k + b"\x00" for k in range(70)] + [bytes(rng.choice(b"abAB") for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    t = W.WordTable(W.hash64)
    for part in (words[:500], words, words[::-1]):
        rows, starts = W.split(t, [b" ".join(part), b"", b" \n"])
        assert t.columns[0][rows].tolist() == W.hash64(part)[0].tolist() and starts.tolist() == [0, len(part), len(part), len(part)]
    assert len(t) == len(set(words))


def test_places_by_plain_python():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aAbB19.,-'\xc3\xa9") for _ in range(rng.randrange(1, 7))) for _ in range(4000)]
    shape = lambda w: re.sub(rb"(.)\1+", rb"\1", bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c > 127 else ord("0") if 48 <= c <= 57 else c for c in w))
    for got, name in zip(mixing._places(words), (lambda w: w.lower().strip(b".,'"), shape), strict=True):
        by: dict = {}
        assert all(by.setdefault(name(w), p) == p for w, p in zip(words, got.tolist(), strict=True))
        assert len(set(by.values())) >= 0.9 * len(by)
    assert all(len(x) == 0 for x in mixing._places([]))


def test_token_table_forgets():
    from tessera.llm import packing
    from tessera.llm.queries import tokenizer_path

    t = packing.TokenTable(tokenizer_path())
    t.table.limit = 40
    rng = random.Random(4)
    for _ in range(30):
        words = [f"wörd{int(rng.paretovariate(0.6)) % 300}x" for _ in range(60)]
        ids, at = t.tokens(*W.split(t.table, [" ".join(words).encode()]))
        assert ids.tolist() == t.subwords.tokenizer.encode(" ".join(words), add_special_tokens=False).ids and at[-1] == len(ids)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "A <|ENDOFTEXT|> B", "x<|endoftext|>y. FOO'S", "<|startoftext|>", "It'S <| b |>c <|startoftext|>, 12 Été", "plain Text"])
def test_special_tokens(text):
    from tessera.llm import packing
    from tessera.llm.queries import tokenizer_path

    t = packing.TokenTable(tokenizer_path())
    ids, _ = t.tokens(*W.split(t.table, [packing.spelled(text.encode())]))
    assert ids.tolist() == t.subwords.tokenizer.encode(text, add_special_tokens=False).ids


def test_attention_by_loops():
    """Losses and scores by plain loops over positions, and gradients by differences; targets lie in few groups, and some positions have none."""
    rng = np.random.default_rng(1)
    model = lm.Attention(30, 4)
    inputs, targets = rng.integers(0, 31, (5, lm.WINDOW)), rng.choice([-1, 0, 1, 7, 8, 29], (5, lm.SPAN))

    def slow() -> np.ndarray:
        p = {k: v.astype(float) for k, v in model.p.items()}
        out = np.zeros(targets.shape)
        for w, i in np.argwhere(targets >= 0).tolist():
            x = p["E"][inputs[w, : lm.LEAD + i + 1]] + p["P"][: lm.LEAD + i + 1]
            a = np.exp(x[-1] @ p["Q"] @ (x @ p["K"]).T / 2)
            h = x[-1] + a @ (x @ p["V"]) / a.sum() @ p["O"]
            group, member = divmod(targets[w, i], model.members)
            for z, own in ((h @ p["U"] + p["b"], group), (h @ p["M"][group] + p["c"][group] + model.absent[group], member)):
                out[w, i] += z[own] - np.log(np.exp(z).sum())
        return out

    assert np.allclose(model.log_probabilities(inputs, targets, 2), slow(), atol=1e-5)
    loss, g = model.step(inputs, targets)
    n = (targets >= 0).sum()
    assert np.isclose(loss, -slow().sum() / n, atol=1e-5) and {k: v.shape for k, v in g.items()} == {k: v.shape for k, v in model.p.items()}
    for k, v in model.p.items():
        at = tuple(int(rng.integers(0, m)) for m in v.shape) if k != "c" else (0, 1)
        was, ends = v[at], []
        for step in (1e-2, -1e-2):
            v[at] = was + np.float32(step)
            ends.append(-slow().sum() / n)
        v[at] = was
        assert np.isclose(g[k][at], (ends[0] - ends[1]) / 2e-2, rtol=0.02, atol=2e-4), k
    assert model.step(inputs, np.full(targets.shape, -1))[0] == 0 and not model.log_probabilities(inputs, np.full(targets.shape, -1)).any()


def test_a_step_calls_few_operations():
    """The exponentials of all groups are taken at once: a call each for the attention, the groups and their members."""
    rng = np.random.default_rng(2)
    model = lm.Attention(1024, 16)
    inputs, targets = rng.integers(0, 1024, (8, lm.WINDOW)), rng.integers(0, 1024, (8, lm.SPAN))
    calls, exp = [], np.exp
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
        model.step(inputs, targets)
        model.log_probabilities(inputs, targets)
    assert len(calls) == 6


def test_windows_score_each_token_once():
    starts = np.array([0, 5, 5, 45])
    classes = np.arange(45, dtype=np.int16)
    inputs, targets, text = lm.windows(classes, starts, 99)
    assert targets[targets >= 0].tolist() == list(range(45)) and np.bincount(text).tolist() == [1, 0, 3]
    for i, t in zip(inputs, targets, strict=True):
        for k in range(lm.SPAN):
            if t[k] not in (-1, 0, 5):
                assert i[lm.LEAD + k] == t[k] - 1


def test_attention_learns_and_sums_to_one():
    rng = np.random.default_rng(0)
    tape = np.tile(np.arange(6, dtype=np.int16), 400)
    inputs, targets, _ = lm.windows(tape, np.array([0, len(tape)]), 6)
    model = lm.Attention(6, 8)
    steps = [(inputs[a : a + 16].astype(np.int64), targets[a : a + 16].astype(np.int64)) for a in range(0, len(inputs), 16)]
    before = model.step(inputs.astype(np.int64), targets.astype(np.int64))[0]
    model.learn(steps * 60, 6e-3)
    assert model.step(inputs.astype(np.int64), targets.astype(np.int64))[0] < 0.2 * before
    pick = rng.integers(0, len(inputs), 3)
    total = sum(np.exp(model.log_probabilities(inputs[pick], np.full_like(targets[pick], c))) for c in range(6))
    assert np.allclose(total, 1, atol=1e-4)
    loss, _ = model.step(inputs[pick].astype(np.int64), targets[pick].astype(np.int64))
    assert loss == pytest.approx(-float(model.log_probabilities(inputs[pick], targets[pick])[targets[pick] >= 0].mean()), abs=1e-4)


def test_later_tokens_do_not_show():
    model = lm.Attention(10, 8)
    inputs = np.random.default_rng(0).integers(0, 10, (1, lm.WINDOW))
    targets = np.zeros((1, lm.SPAN), np.int64)
    a = model.log_probabilities(inputs, targets)
    inputs[0, -1] = (inputs[0, -1] + 1) % 10
    b = model.log_probabilities(inputs, targets)
    assert np.allclose(a[0, :-1], b[0, :-1]) and not np.allclose(a[0, -1], b[0, -1])


def test_gradients():
    model = lm.Attention(5, 4, seed=3)
    rng = np.random.default_rng(1)
    inputs, targets = rng.integers(0, 6, (2, lm.WINDOW)), rng.integers(0, 5, (2, lm.SPAN))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.step(inputs, targets)
    for name in ("E", "Q", "K", "V", "O", "U", "P", "M", "c"):
        at = tuple(np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up, _ = model.step(inputs, targets)
        model.p[name][at] = old - 1e-5
        down, _ = model.step(inputs, targets)
        model.p[name][at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-2), name
