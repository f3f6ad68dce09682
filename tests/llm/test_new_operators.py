"""Chat formatting, prefix trie and Merkle manifest against plain Python, on nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, merkle, trie
from tessera.llm.merkle import ARITY

TURNS = "conv_id long, turn long, role string, text string"
CLASH = ("turns", "formatted", "loss", "read", "same", "rank", "last", "depth", "node", "parent", "h", "k", "head", "t1", "words", "key", "leaf", "root", "part", "level", "pos", "digest", "changed", "more")


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HARD = ["", " ", "plain text", "</s>", "<s>", "[INST] x [/INST]", "<\\/s>", "<\\\\\\/s>", "[\\INST]", " [/INST]", "[/INST", "<<s>", "[ROLE]", "[TURN] ", " [/TURN]", "[/SYSTEM] [SYSTEM] ", "a\nb\n", "$1 \\ $", "é日本\x00😀", "\\", "[\\\\", "<", "[", "</s", "s>"]
ROLES = ["user", "assistant", "system", "tool", "", None, "</s>", "[TURN] ", "us er\n", "[ROLE]", "assistant "]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 6)):
            text = rng.choice([None, "".join(rng.choice(HARD) for _ in range(rng.randrange(5)))])
            rows.append((c if c else None, rng.choice([t, t, None]), rng.choice(ROLES), text))
    rows += [rows[3], rows[3], (1000, 0, "user", "long </s> " * 20_000), (1000, 1, "assistant", "\\n[INST] " * 20_000)]
    made = {r.conv_id: r for r in chat.format_conversations(clashing(spark.createDataFrame(rows, TURNS))).collect()}
    told = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(made) == set(told) == set(want)
    bare = re.compile(r"</?s>|\[/?(?:SYSTEM|INST|TURN)\]|\[ROLE\]")
    for c, turns in want.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        m, d = made[c], told[c]
        assert [(t.role, t.text) for t in m.turns] == turns
        # between the template's own strings no text holds one
        kinds = Counter({"s": 0})
        for r, _ in turns:
            kinds.update(bare.findall("".join(chat.TEMPLATE[r]) if r in chat.TEMPLATE else chat.OTHER_OPEN + chat.OTHER_NAMED + chat.OTHER_CLOSE))
        assert Counter(bare.findall(m.formatted)) == Counter({k: v for k, v in kinds.items() if v})
        assert sum(x.chars for x in m.loss) == len(m.formatted) == d.formatted_chars
        learned, at = "", 0
        for x in m.loss:
            learned += re.sub(r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*(?:/?(?:SYSTEM|INST|TURN)|ROLE)\])", "", m.formatted[at + x.skip : at + x.skip + x.keep])
            at += x.chars
        said = "".join(x for r, x in turns if r == "assistant")
        assert learned == said and (d.loss_chars, d.loss_sha256) == (len(said), sha(said))
        assert (d.n_turns, d.turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.format_conversations(none).count() == 0
    row = chat.formatted_digests(spark, none).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in row] == [(-7, 2, 21)]
    assert "Python" not in chat.formatted_digests(spark, none)._jdf.queryExecution().executedPlan().toString()


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", x or ""))
    full = {}
    for c in by:
        by[c].sort(key=lambda t: t[0])
    for c in by:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = [t[1:] for t in by.get(c - c % 20, [])[:h]] + [t[1:] for t in by[c][h:]]
    nodes = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += kids[k] == 0
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))))) for k, m in nodes.items())


def trie_rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in trie.prefix_trie(df).collect())


@pytest.mark.parametrize("shape", ["mixed", "caterpillar", "copies"])
def test_trie(spark, shape, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "IDS", 4)
    rng = random.Random(3)
    rows = []
    if shape == "mixed":
        for c in rng.sample(range(400), 120):
            for t in range(rng.randrange(1, 6)):
                rows.append((c, t if t else rng.choice([0, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "one two", "a\tb c", "x"])))
        rows += [(None, 0, "user", "no conversation")]
    elif shape == "caterpillar":  # each conversation leaves a common path one turn later
        for c in range(1, 60):
            rows += [(20 * c, t, "user", f"common {t}") for t in range(c)] + [(20 * c, c, "user", f"own {c}")]
    else:  # long equal ones, and their beginnings
        for c in range(12):
            rows += [(c, t, "user", f"turn {t}") for t in range(40 if c % 3 else 17)]
    rng.shuffle(rows)
    assert trie_rows(clashing(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_trie_of_ties_and_nothing(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == []
    # rows of one number, and rows that repeat, are turns each; their order is one whatever the order of rows
    rows = [(20, 0, "user", "b"), (20, 0, "user", "a"), (20, 0, "user", "a"), (40, 0, "user", "a"), (40, 0, "user", "b"), (40, 0, "user", "a")]
    one, two = (trie_rows(spark.createDataFrame(r, TURNS)) for r in (rows, rows[::-1]))
    assert one == two and max(r[1] for r in one) == 3 and one[0][3] == 2


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    at, paths, nodes = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(nodes) > 1:
        for x in range(len(leaves)):
            r = at[x] // ARITY
            run, i = nodes[ARITY * r : ARITY * r + ARITY], at[x] % ARITY
            paths[x].append((i, run[:i] + run[i + 1 :]))
            at[x] = r
        nodes = [sha("".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
    return nodes[0], paths


def brute_manifest(rows):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    by = defaultdict(list)
    for d, s, lang, n, t in rows:
        leaf = sha("".join(map(encoded, (d, s, lang, n, t))))
        spoiled = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by[s].append(((d is not None, d or 0, leaf), sha("".join(map(encoded, (d, s, lang, n, t and t.translate(lower))))) if spoiled else leaf, d))
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[0][2] for x in sorted(by[s])]) for s in keys}
    root, tops = tree([trees[s][0] for s in keys])
    out, proofs = [], []
    for s, top in zip(keys, tops, strict=True):
        for (place, spoiled, d), path in zip(sorted(by[s]), trees[s][1], strict=True):
            f = spoiled
            for i, others in path + top:
                f = sha("".join(others[:i] + [f] + others[i:]))
            out.append((d, place[2], trees[s][0], root, sha("".join("".join(o) for _, o in path + top)), f, f == root))
            proofs.append((d, place[2], trees[s][0], root, [i for i, _ in path + top], ["".join(o) for _, o in path + top]))
    return out, proofs


@pytest.mark.parametrize("sizes", [{"a": 700, "b": 1, None: 40, "": 17, "é": 16}, {"one": 1}, {"x": 4100}, {f"s{k}": 1 for k in range(40)}, {f"s{k:03}": 3 for k in range(300)}])
def test_manifest(spark, sizes):
    rng = random.Random(5)
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            n += 1
            rows.append((rng.choice([n, n, n, None]) if len(sizes) > 1 else n, source, rng.choice(["en", None]), rng.choice([n, None]), rng.choice(["Some Text É", "lower", None, "", "Z" * 30])))
    rows += rows[:1] * 2
    rng.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7))
    want, proofs = brute_manifest(rows)
    got = merkle.audit(df, merkle.to_be_tampered(), merkle.lowered(F.col("text")))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    told = merkle.manifest(df).collect()
    assert sorted(map(str, (tuple(r) for r in told))) == sorted(map(str, proofs))


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(none).count() == 0 and merkle.audit(none, F.lit(True), F.lit("x")).count() == 0


@pytest.mark.parametrize("counts", [[[("a", 5)], [], [("a", 40)], [("a", 300), ("b", 2)], [("b", 14), ("c", 1), ("d", 20)], [("d", 1)]], [[], []]])
def test_places(counts):
    """Ranges of any cut lead to the same roots."""
    ends = [(len(p), (merkle._token(p[0][0]), p[0][1]), (merkle._token(p[-1][0]), p[-1][1])) if p else (0, None, None) for p in counts]
    whole, before = Counter(), Counter()
    for p in counts:
        whole.update(dict(p))
    for p, (start, first, last) in zip(counts, merkle.places(ends), strict=True):
        if p:
            assert (start, first, last) == (before[p[0][0]], whole[p[0][0]], whole[p[-1][0]])
            before.update(dict(p))
