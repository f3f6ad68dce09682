"""Language identification against plain Python, and on pages of known language."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import langid

DOCS = [(1, "the cat and the dog that was in the house", "en"), (2, "der hund und die katze in dem haus", "de"), (3, "le chat et le chien dans la maison", "fr"), (4, "the end", "en")]


def page(lang, text):
    return f'<html{f" lang={lang}" if lang else ""}><body><article><p>{text}</p></article></body></html>'


ROWS = [
    (1, "http://a.example.com/x", page("en", "the house and the cat")),
    (2, "http://b.example.de/", page("xx", "die katze und der hund")),
    (3, "http://b.example.de/2", page("de", "")),
    (4, "http://c.example.de/2", page(None, "hund")),
    (5, "http://a.example.com/y", page("fr", "the dog")),
    (6, "http://A.example.com/y", page("FR-ca", "le chien")),
    (7, None, page(None, "la maison")),
    (7, None, page(None, "la maison")),
    (8, "http://a.example.com/x", None),
]


def trigrams(text):
    b = b" " + b" ".join(text.lower().encode().split()) + b" "
    out = defaultdict(int)
    for k in range(len(b) - 2):
        out[((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 % (1 << 32)) >> 17] += 1
    return out


def normal(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def by_hand():
    names = sorted({d[2] for d in DOCS})
    n = len(names)
    counts = {x: defaultdict(int) for x in names}
    for _, text, lang in DOCS:
        for t, c in trigrams(text).items():
            counts[lang][t] += c
    total = {x: sum(counts[x].values()) + 0.5 * langid.PLACES for x in names}
    rows = []
    for i, url, html in ROWS:
        text = re.sub("<[^>]*>", "", html or "")
        logs = [langid.TEMPER * sum(c * math.log((counts[x][t] + 0.5) / total[x]) for t, c in trigrams(text).items()) if text else 0.0 for x in names]
        m = re.search(r"lang=(\w+)", html or "")
        said = m[1].lower() if m else None
        host = re.match(r"http://([^/]*)", (url or "").lower())
        host = host[1] if host else ""
        rows.append([i, "(none)" if said is None else said if said in names else "(other)", host, logs])
    sums = defaultdict(lambda: [0.0] * n)
    for _, kind, _, logs in rows:
        sums[kind] = [a + b for a, b in zip(sums[kind], normal(logs), strict=True)]
    every = [sum(s[k] for s in sums.values()) for k in range(n)]
    for r in rows:
        r[3] = [v + math.log((sums[r[1]][k] + 0.1) / (every[k] + 0.1 * (n + 2))) for k, v in enumerate(r[3])]
        r.append(normal(r[3]))
    levels = [lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h]
    out = defaultdict(list)
    for i, _, host, logs, p in rows:
        prior = [(x + 1) / (sum(every) + n) for x in every]
        for level in levels:
            s = [sum(r[4][k] for r in rows if level(r[2]) == level(host)) - p[k] for k in range(n)]
            raw = [max(0.0, a) + langid.STRENGTH * b for a, b in zip(s, prior, strict=True)]
            prior = [x / sum(raw) for x in raw]
        q = normal([a + math.log(b) for a, b in zip(logs, prior, strict=True)])
        out[i].append((names[int(np.argmax(q))], max(q)))
    return out


def test_fusion_against_plain_python(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    want, got = by_hand(), defaultdict(list)
    for r in langid.identify(spark.createDataFrame(ROWS, "page_id long, url string, html string"), docs).collect():
        got[r.page_id].append((r.lang, r.probability))
    assert set(got) == set(want)
    for i, x in want.items():
        assert [v[0] for v in got[i]] == [v[0] for v in x] and np.allclose([v[1] for v in got[i]], [v[1] for v in x], atol=1e-5)


def test_every_language_counts(spark):
    """A rare language among a hundred others."""
    docs = spark.createDataFrame([(k, f"w{k}x w{k}y " * 5, f"l{k:03}") for k in range(100)], "doc_id long, text string, lang string")
    got = langid.identify(spark.createDataFrame([(1, "http://a.b/", page(None, "w57x w57y w57x"))], "page_id long, url string, html string"), docs).collect()
    assert got[0].lang == "l057"


def test_accuracy(spark):
    """The text alone, and all evidence, against the language that the pages declare."""
    root = "/root/testdata/sf0.01"
    rows = langid.identify(spark.read.parquet(f"{root}/pages.parquet"), spark.read.parquet(f"{root}/documents.parquet")).where("declared in ('de', 'en', 'es', 'fr')").collect()
    assert len(rows) > 200
    assert sum(r.text_lang == r.declared for r in rows) >= 0.95 * len(rows)
    assert sum(r.lang == r.declared for r in rows) >= 0.95 * len(rows)
