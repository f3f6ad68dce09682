"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose feature is above a cutoff of the document's stratum. Labelled texts are split in two
halves by a hash. On the tuning half an ordered path of rejection regions is built, each one wider than the last by one
rule's lower cutoff, those that reject most bad for each good label first. On the holdout half the regions are tested in
that order: a region, all rules together, is certified if the exact (Clopper-Pearson) upper bound on the share of good
labels that it rejects is within the allowed risk. Testing stops at the first that is not, so the path needs no
correction for its length; strata divide the error (Bonferroni). With probability 1 - delta, in every stratum the rules
reject at most `risk` of the good documents like those labelled. A stratum without labels enough to certify a region has
no rules but the base ones, since nothing could be promised for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.storage import discard, materialize, shield

#: The rules: a feature, of which higher is worse, and its grid of cutoffs from strict to loose.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 4.0),
    "exclamations_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 4.0),
    "upper_case_words": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 0.95),
    "repeated_lines": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 0.95),
    "repeated_words": (0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2, 0.22, 0.25, 0.27, 0.29),
    "other_characters": (0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7),
    "word_length": (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 40.0),
    "few_words": (-60.0, -50.0, -45.0, -40.0, -35.0, -32.0, -30.0, -28.0, -26.0, -24.0, -22.0),
}
#: Least words, and the highest share of words in repeated 8-word windows in percent; below and above these a document fails.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("text_key", T.LongType())])
#: The stratum of documents that have none; and how many bad labels a step of the path rejects at least for each good one.
NONE, BAD_FOR_GOOD = "(none)", 4


def _of_words(new: list[bytes]) -> tuple[np.ndarray, ...]:
    chars, symbols, bangs, upper, other = (np.zeros(len(new), np.int64) for _ in range(5))
    for k, w in enumerate(new):
        text = w.decode("utf-8", "replace")
        chars[k] = len(text)
        symbols[k] = len(w) - len(w.translate(None, SYMBOLS))
        bangs[k] = w.count(b"!")
        letters = [c for c in text if c.isalpha()] if not text.isalpha() else text
        other[k] = len(text) - len(letters)
        upper[k] = len(letters) > 1 and text.isupper()
    return chars, symbols, bangs, upper, other


def repeated_words(rows: np.ndarray, window: int) -> int:
    """How many of the words lie in windows of `window` words that occur twice or more."""
    n = len(rows) - window + 1
    if n < 2:
        return 0
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll = W.mix64(roll + rows[k : n + k].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(roll)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(roll, twice))
    step = np.zeros(len(rows) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int(np.count_nonzero(np.cumsum(step)))


def measure(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The counts (COUNTS, a row for each text) and the rules' features."""
    table = W.held("quality", lambda: W.WordTable(_of_words))
    rows, starts = W.split(table, blobs)
    sums = [np.concatenate(([0], np.cumsum(c[rows])))[starts] for c in table.columns]
    chars, symbols, bangs, upper, other = (np.diff(s) for s in sums)
    n = np.diff(starts)
    dup, lines, again = (np.zeros(len(blobs), np.int64) for _ in range(3))
    for d, b in enumerate(blobs):
        full = [x for x in b.split(b"\n") if x.strip()]
        lines[d] = len(full)
        dup[d] = len(full) - len(set(full))
        again[d] = repeated_words(rows[starts[d] : starts[d + 1]], WINDOW)
    words, shown = np.maximum(n, 1), np.maximum(chars, 1)
    features = [symbols / words, bangs / words, upper / words, dup / np.maximum(lines, 1), again / words, other / shown, chars / words, -n.astype(float)]
    return np.stack([n, chars, symbols, dup, again], 1), np.stack(features, 1)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound on a share of which k in n were seen: the p with P(X <= k) = delta."""
    if n == 0 or k >= n:
        return 1.0
    if k == 0:
        return 1.0 - delta ** (1.0 / n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        if top + math.log(sum(math.exp(x - top) for x in terms)) > math.log(delta):
            lo = p
        else:
            hi = p
    return hi


def path(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """Steps (rule, least level rejected), in order. levels: for groups of labelled texts, how many cutoffs of each rule their feature is above; good, bad: how many texts each group has."""
    out: list[tuple[int, int]] = []
    live = np.ones(len(levels), bool)
    while True:
        best = None
        for j, grid in enumerate(RULES.values()):
            # texts not yet rejected, by their level, from the highest down
            g, b = (np.bincount(levels[live, j], x[live], len(grid) + 1)[::-1].cumsum()[::-1] for x in (good, bad))
            for t in range(1, len(grid) + 1):
                if b[t] > 0 and b[t] >= BAD_FOR_GOOD * g[t]:
                    rank = (b[t] / (g[t] + 0.5), b[t], -j, t)
                    best = max(best, (rank, j, t)) if best else (rank, j, t)
        if best is None:
            return out
        _, j, t = best
        out.append((j, t))
        live &= levels[:, j] < t


def certify(steps: list[tuple[int, int]], levels: np.ndarray, good: np.ndarray, risk: float, delta: float) -> list[float]:
    """The rules' cutoffs (infinite where a rule is off) of the last region of the path that is certified on the holdout groups before one that is not."""
    grids = list(RULES.values())
    cutoffs, rejected, n = [math.inf] * len(grids), np.zeros(len(levels), bool), int(good.sum())
    for j, t in steps:
        rejected |= levels[:, j] >= t
        if upper_bound(int(good[rejected].sum()), n, delta) > risk:
            break
        cutoffs[j] = grids[j][t - 1]
    return cutoffs


def labelled(labels: DataFrame) -> DataFrame:
    """(labelled_id, good): one row for each labelled doc_id; a document labelled both ways counts as good."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled_id")).agg((F.max("quality") > 0).alias("good"))


def thresholds(measures: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.05, delta: float = 0.05) -> dict[str, list[float]]:
    """Cutoffs by stratum from the measures (doc_id, stratum, features, text_key) of labelled documents that pass the base rules.

    Texts that repeat in a stratum count once. What reaches the driver are counts of groups of equal levels: as many as
    the grids tell apart, not as many as documents.
    """
    rows = measures.join(labelled(labels), F.col("doc_id") == F.col("labelled_id"))
    rows = rows.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT * F.col("n_words")))
    level = F.array(*(sum(((F.col("features")[j] > c).cast("int") for c in grid), F.lit(0)) for j, grid in enumerate(RULES.values())))
    texts = rows.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit(NONE)).alias("s"), "text_key", level.alias("levels")).agg(F.max("good").alias("good"))
    half = F.pmod(F.xxhash64("text_key", F.lit("half")), F.lit(2))
    seen = texts.groupBy("s", half.alias("half"), "levels").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).collect()
    by: dict[str, tuple[list, list]] = {}
    for r in seen:
        by.setdefault(r["s"], ([], []))[r["half"]].append(r)
    out = {}
    for s, halves in sorted(by.items()):
        (tl, tg, tb), (hl, hg, _) = ((np.array([r["levels"] for r in x], int).reshape(-1, len(RULES)), np.array([r["g"] for r in x], int), np.array([r["b"] for r in x], int)) for x in halves)
        out[s] = certify(path(tl, tg, tb), hl, hg, risk, delta / len(by))
    return out


def measured(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep` with the counts and features of every row."""
    fields = [documents.schema[c] for c in keep]
    schema = T.StructType([*fields, *MEASURES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            counts, features = measure(blobs)
            ends = np.arange(len(blobs) + 1, dtype=np.int32) * features.shape[1]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array(counts[:, k]) for k in range(len(COUNTS))]
            keys = np.array([xxhash.xxh3_64_intdigest(b) for b in blobs], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(features.reshape(-1))), pa.array(keys)], names=schema.names)

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def verdicts(documents: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of the rules that reject, for every row.

    A null text has no words and fails the base rules; rows of a null stratum are a stratum of their own; where nothing
    is certified, the base rules alone decide. Repeated rows each appear; an empty table gives no rows; other columns are
    ignored.
    """
    rows = materialize(measured(documents, ["doc_id", stratum]), "measures")
    return judge(rows, thresholds(rows, labels, stratum, **risk), stratum).select("doc_id", *COUNTS, "base_failed", "kept", "rules")


def judge(rows: DataFrame, cutoffs: dict[str, list[float]], stratum: str) -> DataFrame:
    """Adds base_failed, rules and kept to measured rows."""
    off = F.array(*(F.lit(math.inf) for _ in RULES))
    cut = off
    if cutoffs:
        table = F.create_map(*(x for s, values in cutoffs.items() for x in (F.lit(s), F.array(*map(F.lit, values)))))
        cut = F.coalesce(F.try_element_at(table, F.coalesce(F.col(stratum).cast("string"), F.lit(NONE))), off)
    fired = [F.when(F.col("features")[j] > cut[j], F.lit(rule)) for j, rule in enumerate(RULES)]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("rules", F.array_compact(F.array(*fired))).withColumn("kept", ~failed & (F.size("rules") == 0))


def keep_documents(documents: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """The rows of documents, with all their columns, that the rules keep, as verdicts() says. Measures twice: once for the cutoffs, once to filter, so that no text is shuffled."""
    rows = materialize(measured(documents.select("doc_id", stratum, "text"), ["doc_id", stratum]), "measures")
    cutoffs = thresholds(rows, labels, stratum, **risk)
    discard(rows)
    inner, restore = shield(documents, ("doc_id", "text", stratum))
    return restore(judge(measured(inner, inner.columns), cutoffs, stratum).where("kept"))
