"""Mixing documents to target weights by soft membership.

A classifier learned from the labelled table gives each document a probability of each domain. Nonnegative rates, one for
each document, make the expected token totals of the domains meet their targets: least squares by projected gradient.
From rate 1 for all, each step moves a document's rate against the gradient, p.g for its probabilities p, and holds it
at 0 or above; g has the domains' residuals, each scaled by the domain's own curvature. A step is as many numbers as
there are domains, so a document's rate is replayed from the steps so far wherever it is needed; each iteration is one
aggregate over a narrow table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.neardup import shingle_sets
from tessera.llm.storage import discard, materialize, shield

DOMAINS = ("clean", "junk", "toxic")
#: Hash places of words and word shapes; with the classes they bound the model's size.
PLACES = 1 << 16
#: Labelled rows that the classifier learns from: all up to so many, of more a share by a hash. Their ids and domains (16 bytes each) go to all workers.
TRAIN_ROWS = 200_000
_OUTER = np.zeros(256, bool)
_OUTER[list(b".,;:!?|\"'()*#$%&<>")] = True
_SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))


def _places(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the place of its lower-case form without outer punctuation, and that of its shape (runs of letters as one)."""
    joined = b"\n" + b"\n".join(new) + b"\n"  # words hold no line break
    edges = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    begin, end = edges[:-1] + 1, edges[1:].copy()
    data = np.frombuffer(joined, np.uint8)
    shape = np.frombuffer(joined.translate(_SHAPE), np.uint8)
    short = shape[np.concatenate(([True], shape[1:] != shape[:-1]))]
    for at, step, last in ((begin, 1, 0), (end, -1, -1)):
        rest = np.arange(len(begin) * bool(new))
        while len(rest := rest[(begin[rest] < end[rest]) & _OUTER[data[at[rest] + last]]]):
            at[rest] += step
    edges = np.flatnonzero(short == 10)
    shapes = W.exact_hashes(short.tobytes() + W.PAD, edges[:-1] + 1, np.diff(edges) - 1) if new else np.zeros(0, np.uint64)
    names = W.exact_hashes(joined.lower() + W.PAD, begin, end - begin) if new else shapes
    return tuple((x & np.uint64(PLACES - 1)).astype(np.int32) for x in (names, W.mix64(shapes + np.uint64(1))))


def features(blobs: list[bytes], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' distinct places (among the used ones, if given): the text's number and the place; and each text's count of words."""
    table = W.held("places", lambda: W.WordTable(_places))
    rows, starts = W.split(table, blobs)
    n = np.diff(starts)
    text = np.repeat(np.arange(len(n)) * PLACES, n)
    keys = []
    for column in table.columns:
        place = column[rows]
        at = slice(None) if used is None else np.flatnonzero(used[place])
        keys.append(text[at] + place[at])
    both = np.unique(np.concatenate(keys))
    return both // PLACES, both % PLACES, n


def labelled(labels: DataFrame) -> DataFrame:
    """(labelled_id, domain): toxic documents, junk (quality 0) and clean ones; a document labelled more than once gets the best quality and the worst toxicity. Null labels count as quality 1, toxic 0."""
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max(F.coalesce("quality", F.lit(1))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return rows.select("labelled_id", F.when(F.col("t") > 0, 2).when(F.col("q") <= 0, 1).otherwise(0).alias("domain"))


class Classifier:
    """Naive Bayes over the places that are present, or absent, far more often in one domain than in another: beyond chance (|z| >= least_z) and `least_ratio` times as often. Words that merely go with the length of a domain's texts are below that. Its evidence is turned into probabilities by a logistic regression on labelled documents that it has not counted."""

    def __init__(self, counts: np.ndarray, documents: np.ndarray, least_z: float = 6.0, least_ratio: float = 4.0):
        self.learned = bool(documents.sum())
        n = np.maximum(documents, 1.0)[:, None]
        share = (counts + 0.5) / (n + 1.0)
        overall = (counts.sum(0) + 0.5) / (documents.sum() + 1.0)
        z = (counts / n - overall) / np.sqrt(overall * (1 - np.minimum(overall, 1 - 1e-9)) / n)
        self.used = (np.abs(z).max(0) >= least_z) & (share.max(0) >= least_ratio * share.min(0))
        absent = np.log(1 - np.minimum(share, 1 - 1e-9))
        gain = np.where(self.used, np.log(share) - absent, 0.0)
        self.weights = gain - gain.mean(0)
        base = np.where(self.used, absent, 0.0).sum(1)
        self.bias = np.log((documents + 1.0) / (documents.sum() + len(documents))) + base - base.mean()
        self.logistic: np.ndarray | None = None

    def evidence(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log weights of the domains, and counts of words."""
        text, place, n = features(blobs, self.used)
        return np.stack([np.bincount(text, w[place], len(blobs)) + b for w, b in zip(self.weights, self.bias, strict=True)], 1), n

    @staticmethod
    def _inputs(logs: np.ndarray) -> np.ndarray:
        """Evidence against the first domain, far values drawn in, and 1."""
        return np.concatenate((np.arcsinh(logs[:, 1:] - logs[:, :1]), np.ones((len(logs), 1))), 1)

    def calibrate(self, logs: np.ndarray, domain: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> None:
        """Fits the logistic regression by Newton steps."""
        x, k = self._inputs(logs), logs.shape[1]
        y = np.eye(k)[domain]
        w = np.zeros((k - 1, x.shape[1]))
        for _ in range(rounds):
            p = self._softmax(x @ w.T)
            g = ((p - y)[:, 1:].T @ x + ridge * w).reshape(-1)
            q = p[:, 1:]
            h = np.einsum("nab,ni,nj->aibj", np.einsum("na,ab->nab", q, np.eye(k - 1)) - q[:, :, None] * q[:, None, :], x, x, optimize=True)
            step = np.linalg.solve(h.reshape(len(g), -1) + ridge * np.eye(len(g)), g)
            w -= (step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))).reshape(w.shape)
        self.logistic = w

    @staticmethod
    def _softmax(rest: np.ndarray) -> np.ndarray:
        z = np.concatenate((np.zeros((len(rest), 1)), rest), 1)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posteriors(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the domains, and counts of words."""
        logs, n = self.evidence(blobs)
        return self._softmax(logs[:, 1:] - logs[:, :1] if self.logistic is None else self._inputs(logs) @ self.logistic.T), n


def _kinds(rows: DataFrame) -> DataFrame:
    """labelled_id, domain and the least hash of the text's five-word shingles, which copies and most near copies have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            hashes, starts = shingle_sets(blobs, 5)
            least = np.array([hashes[a] if b > a else 0 for a, b in zip(starts[:-1], starts[1:], strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("labelled_id", "domain")] + [pa.array(least)], names=["labelled_id", "domain", "least"])

    return rows.select("labelled_id", "domain", "text").mapInArrow(run, T.StructType([rows.schema["labelled_id"], T.StructField("domain", T.IntegerType()), T.StructField("least", T.LongType())]))


def train(documents: DataFrame, labels: DataFrame) -> Classifier:
    """Counts, for each domain, the labelled documents (up to about TRAIN_ROWS) that have each place: partial sums in each task, then a grouped sum of at most domains x PLACES rows. Of labelled copies of one text, near ones too, one counts, so that a much copied text does not teach its words."""
    k = len(DOMAINS)
    known = labelled(labels)
    share = TRAIN_ROWS / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("labelled_id", F.lit("train")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    of = lambda x: documents.select("doc_id", "text").join(F.broadcast(x), F.col("doc_id") == F.col("labelled_id"))
    known = materialize(_kinds(of(known)).groupBy("domain", "least").agg(F.min("labelled_id").alias("labelled_id")).select("labelled_id", "domain", F.pmod(F.xxhash64("least", F.lit("half")), F.lit(2)).alias("half")), "labelled")
    rows = of(known).select("domain", "half", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * (PLACES + 1), np.int64)
        for batch, blobs in W.chunks(batches, "text"):
            domain = batch.column(batch.schema.get_field_index("domain")).to_numpy(zero_copy_only=False).astype(np.int64)
            text, place, _ = features(blobs)
            counts += np.bincount(domain[text] * (PLACES + 1) + place, minlength=len(counts))
            counts += np.bincount(domain * (PLACES + 1) + PLACES, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at // (PLACES + 1)).astype(np.int32)), pa.array((at % (PLACES + 1)).astype(np.int32)), pa.array(counts[at])], names=["domain", "place", "n"])

    total = rows.where("half = 0").mapInArrow(run, "domain int, place int, n long").groupBy("domain", "place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((k, PLACES + 1))
    counts[total["domain"], total["place"]] = total["n"]
    model = Classifier(counts[:, :PLACES], counts[:, PLACES])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            logs, _ = shared.value.evidence(blobs)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("domain")), *(pa.array(x) for x in logs.T)], names=["domain", *(f"l{i}" for i in range(k))])

    # up to about TRAIN_ROWS / 2 rows
    seen = rows.where("half = 1").mapInArrow(weigh, "domain int, " + ", ".join(f"l{i} double" for i in range(k))).toPandas().sort_values(["domain", *(f"l{i}" for i in range(k))])
    if len(seen):
        model.calibrate(seen[[f"l{i}" for i in range(k)]].to_numpy(float), seen["domain"].to_numpy(int))
    discard(known)
    return model


def memberships(documents: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns in `keep`, n_tokens (words) and p, the domains' probabilities, for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            p, n = shared.value.posteriors(blobs)
            ends = np.arange(len(blobs) + 1, dtype=np.int32) * p.shape[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(p.reshape(-1)))], names=schema.names)

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps, from 1, held at 0 or above."""
    rate = np.ones(len(p))
    for g in steps:
        rate = np.maximum(rate - p @ g, 0.0)
    return rate


#: A domain's total meets its target if it is within this share of all tokens.
TOLERANCE = 1e-4


def _sums(rows: DataFrame, steps: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The domains' expected totals at the rates, and their Gram matrix over documents whose rates are above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rate = replay(p, steps)
            total[:k] += (rate * t) @ p
            total[k:] += ((p * (t * (rate > 0))[:, None]).T @ p).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    got = rows.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(k + k * k)
    out[got["i"]] = got["v"]
    return out[:k], out[k:].reshape(k, k)


def solve(rows: DataFrame, weights: list[float], tolerance: float = TOLERANCE, iterations: int = 60) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps whose replay gives rates that meet the targets; the targets; and the totals reached. The first domain's target is its own tokens, each other's its weight against the first's: less than it has, or more, for which its documents are repeated.

    rows: (n_tokens, p), read once an iteration. The squares of the domains' residuals are weighted by their curvature, the
    sum of n_tokens * p^2 over documents that are not held at 0; a gradient step of 1 / (greatest eigenvalue of the Gram
    matrix so scaled), in the metric of the documents' tokens, cannot overshoot while none is let go. Stops when every
    domain's total is within `tolerance` of all tokens of its target; or else the steps up to the least residual count.
    """
    k, steps = len(weights), []
    w = np.array(weights, float)
    now, gram = _sums(rows, steps, k)
    every = now.sum()
    if not every or not w[0] > 0:
        return steps, now, now
    target = now[0] * w / w[0]
    floor = 1e-9 * np.diag(gram).max()
    best = (np.abs(now - target).max(), 0, now)
    seen = [best[0]]
    # eight steps that take off less than a hundredth do not get there
    while best[0] > tolerance * every and len(steps) < iterations and (len(seen) < 9 or seen[-1] < 0.99 * seen[-9]):
        curve = np.maximum(np.diag(gram), floor)
        length = 1 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(curve, curve)))[-1]
        steps.append(length * (now - target) / curve)
        now, gram = _sums(rows, steps, k)
        best = min(best, (np.abs(now - target).max(), len(steps), now), key=lambda x: x[0])
        seen.append(best[0])
    return steps[: best[1]], target, best[2]


def with_rates(rows: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    """Adds rate, and copies: its whole part, and one more with the probability of the rest, by a hash of doc_id and n_tokens."""
    p = F.col("p")
    rate = F.lit(1.0)
    if steps:
        moves = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in steps))
        rate = F.aggregate(moves, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - sum((p[i] * g[i] for i in range(len(steps[0]))), F.lit(0.0))))
    chance = F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit("mix")), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    return rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


#: Weights of the three domains in the mixture.
WEIGHTS = (0.991, 0.001, 0.008)


@dataclass(frozen=True)
class Mixture:
    """What the rates come to: their steps, and by domain the tokens that were wanted and those that the rates give."""

    steps: list[np.ndarray]
    target: np.ndarray
    reached: np.ndarray
    tokens: float

    @property
    def met(self) -> list[bool]:
        return [bool(x) for x in np.abs(self.reached - self.target) <= TOLERANCE * self.tokens]


def mixture(rows: DataFrame, model: Classifier, weights: tuple[float, ...]) -> Mixture:
    """The rates' steps for memberships; none without labelled documents, where all that there is is wanted."""
    k = len(weights)
    if model.learned:
        steps, target, reached = solve(rows, list(weights), TOLERANCE)
    else:
        now, _ = _sums(rows, [], k)
        steps, target, reached = [], now, now
    return Mixture(steps, target, reached, float(rows.agg(F.sum("n_tokens")).first()[0] or 0))


def mix(documents: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies for every row, and, alike in all rows, target_<domain>, reached_<domain> (expected tokens at the rates) and targets_met.

    The first domain keeps its tokens, at rates near 1; the others are brought to their weights against it, thinned or
    repeated. Where no rates meet all targets, or the solver's steps take next to nothing off, reached_<domain> and
    targets_met say so. A null or empty text has no tokens and the labelled table's own shares as its probabilities; rows
    that repeat are weighed one by one and get the same rate; a null doc_id is an ordinary key of the draw. Without
    labelled documents no domain can be told and all rates are 1. An empty table gives no rows; other columns are ignored.
    """
    model = train(documents, labels)
    rows = materialize(memberships(documents, model, ["doc_id"]), "memberships")
    made = mixture(rows, model, weights)
    out = with_rates(rows, made.steps)
    said = [F.lit(float(x)).alias(f"{name}_{d}") for name, values in (("target", made.target), ("reached", made.reached)) for d, x in zip(DOMAINS, values, strict=True)]
    return out.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", "copies", *said, F.lit(all(made.met)).alias("targets_met"))


def mixed_documents(documents: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The documents, with all their columns, each as often as its copies say, as mix() does for each kind of row."""
    model = train(documents, labels)
    rows = materialize(memberships(documents, model, ["doc_id"]), "memberships")
    steps = mixture(rows, model, weights).steps
    discard(rows)
    inner, restore = shield(documents, ("doc_id", "text"))
    chosen = with_rates(memberships(inner, model, inner.columns), steps)
    return restore(chosen.where("copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
