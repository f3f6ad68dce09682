"""Nearest neighbours by inner product: vantage-point trees per shard.

Largest inner product becomes least Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2), with M the largest
norm of all vectors (0 for queries). A subtree whose distances to the vantage point lie in [lo, hi] is left out for a
query at distance d from it if max(lo - d, d - hi) > factor * (distance of the k-th nearest so far). Factor one is the
triangle inequality itself, so the search is exact; less visits fewer leaves. The shards are the leaves of one such tree
more, grown on a bounded sample, down which every vector is sent: a query goes to the shards that the same rule leaves.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize

#: Vectors in a shard and in a leaf, queries in a block; vectors that the tree over the shards is grown on, and its leaves at most (larger leaves are dealt into several shards).
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, SAMPLE_ROWS, LEAVES = 16_384, 128, 4_096, 4_096, 256
#: Queries that the factor is chosen by, against exact search; the recall that they are to reach; and the factors that are tried, the last of which is exact.
TRIAL_QUERIES, TRIAL_RECALL, FACTORS = 128, 0.975, (0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows, each summed in one order whatever the shapes are, so that equal vectors tie everywhere."""
    return np.einsum("qd,rd->qr", np.ascontiguousarray(q), np.ascontiguousarray(x))


class Tree:
    """A tree over the distinct vectors of one shard. ids: of each vector, its smallest ones in ascending order."""

    def __init__(self, ids: list[np.ndarray], vectors: np.ndarray, top: float):
        order = np.argsort([x[0] for x in ids], kind="stable")
        self.x, self.top = vectors[order], top
        self.id_at = np.concatenate(([0], np.cumsum([len(ids[k]) for k in order])))
        self.ids = np.concatenate([ids[k] for k in order])
        extra = np.sqrt(np.maximum(top * top - (self.x**2).sum(1), 0))
        self.rows = np.arange(len(self.x))  # in the order of their least ids
        self.nodes: list[tuple] = []  # (vantage row, inner child, its lo, hi, outer child, its lo, hi) or (start, end) of a leaf
        rng = np.random.Generator(np.random.PCG64(7))
        self._build(0, len(self.x), extra, rng)

    def _build(self, a: int, b: int, extra: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        if b - a <= LEAF_ROWS:
            self.rows[a:b].sort()
            self.nodes.append((a, b))
            return at
        self.nodes.append(())
        rows = self.rows[a:b]
        v = int(rows[rng.integers(b - a)])
        d = np.sqrt(np.maximum(((self.x[rows] - self.x[v]) ** 2).sum(1) + (extra[rows] - extra[v]) ** 2, 0))
        order = np.argsort(d, kind="stable")
        self.rows[a:b], d, mid = rows[order], d[order], (b - a) // 2
        inner = self._build(a, a + mid, extra, rng)
        outer = self._build(a + mid, b, extra, rng)
        self.nodes[at] = (v, inner, d[0], d[mid - 1], outer, d[mid], d[-1])
        return at

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the k distinct vectors nearest each query, ties to the smaller least id, and their inner products (-inf where fewer)."""
        score, row = np.full((len(q), k), -np.inf), np.full((len(q), k), len(self.x), np.int64)
        far = self.top**2 + (q**2).sum(1)

        def distance(who: np.ndarray, v: int) -> np.ndarray:
            return np.sqrt(np.maximum(far[who] - 2 * (q[who] @ self.x[v]), 0))

        def leaf(who: np.ndarray, a: int, b: int) -> None:
            rows = self.rows[a:b]
            s = np.concatenate((score[who], products(q[who], self.x[rows])), 1)
            r = np.concatenate((row[who], np.broadcast_to(rows, (len(who), len(rows)))), 1)
            by_id = np.argsort(r, axis=1, kind="stable")
            s, r = np.take_along_axis(s, by_id, 1), np.take_along_axis(r, by_id, 1)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            score[who], row[who] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)

        first = np.full(len(q), -1)
        stack = [(0, np.arange(len(q)))]
        while stack:  # to the leaf on each query's own side
            at, who = stack.pop()
            node = self.nodes[at]
            if len(node) == 2:
                first[who] = at
                leaf(who, *node)
            else:
                v, inner, _, hi, outer, lo, _ = node
                near = distance(who, v) <= (hi + lo) / 2
                stack += [(c, x) for c, x in ((inner, who[near]), (outer, who[~near])) if len(x)]
        stack = [(0, np.arange(len(q)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if len(node) == 2:
                who = who[first[who] != at]
                if len(who):
                    leaf(who, *node)
                continue
            v, inner, ilo, ihi, outer, olo, ohi = node
            d = distance(who, v)
            least = score[who].min(1)
            most = np.where(np.isfinite(least), factor * np.sqrt(np.maximum(far[who] - 2 * np.where(np.isfinite(least), least, 0), 0)) + 1e-6 * self.top, np.inf)
            for child, lo, hi in ((outer, olo, ohi), (inner, ilo, ihi)):
                go = who[np.maximum(lo - d, d - hi) <= most]
                if len(go):
                    stack.append((child, go))
        return row, score


class Shards:
    """The tree over the shards. Nodes: (vantage number, its split distance, inner child, outer child), or the leaf's number."""

    def __init__(self, sample: np.ndarray, top: float, leaves: int):
        self.sample, self.top = sample, top
        self.extra = np.sqrt(np.maximum(top * top - (sample**2).sum(1), 0))
        self.vantage: list[int] = []
        self.paths: list[list[int]] = []  # each leaf's vantage numbers
        self.root = self._build(np.arange(len(sample)), leaves, [], np.random.Generator(np.random.PCG64(11)))

    def _build(self, rows: np.ndarray, leaves: int, path: list[int], rng: np.random.Generator):
        if leaves < 2 or len(rows) < 2:
            self.paths.append(path)
            return len(self.paths) - 1
        v = int(rows[rng.integers(len(rows))])
        d = self.distances(self.sample[rows], self.extra[rows], [v])[:, 0]
        cut, mine, path = float(np.median(d)), len(self.vantage), [*path, len(self.vantage)]
        self.vantage.append(v)
        inner = self._build(rows[d <= cut], leaves // 2, path, rng)
        return (mine, cut, inner, self._build(rows[d > cut], leaves - leaves // 2, path, rng))

    def distances(self, x: np.ndarray, extra: np.ndarray, rows: list[int]) -> np.ndarray:
        return np.stack([np.sqrt(((x - self.sample[v]) ** 2).sum(1) + (extra - self.extra[v]) ** 2) for v in rows], 1) if rows else np.zeros((len(x), 0))

    def place(self, x: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's leaf, and its distances to all vantage points."""
        d, leaf = self.distances(x, extra, self.vantage), np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, who = stack.pop()
            if isinstance(node, int):
                leaf[who] = node
            else:
                v, cut, inner, outer = node
                near = d[who, v] <= cut
                stack += [(inner, who[near]), (outer, who[~near])]
        return leaf, d

    def routes(self, q: np.ndarray, k: int, factor: float, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """The leaves to search for each query. lo, hi: of each leaf, the ends of its vectors' distances to each vantage point. The k-th nearest of the sample bounds the distance of the k-th nearest of all."""
        d = self.distances(q, np.zeros(len(q)), self.vantage)
        far = self.top**2 + (q**2).sum(1)
        most = np.full(len(q), np.inf)
        if len(self.sample) >= k:
            least = np.partition(products(q, self.sample), -k, axis=1)[:, -k]
            most = factor * np.sqrt(np.maximum(far - 2 * least, 0)) + 1e-6 * self.top
        out = np.ones((len(q), len(self.paths)), bool)
        for leaf, path in enumerate(self.paths):
            for v in path:
                out[:, leaf] &= np.maximum(lo[leaf, v] - d[:, v], d[:, v] - hi[leaf, v]) <= most
        own, _ = self.place(q, np.zeros(len(q)))
        out[np.arange(len(q)), own] = True
        return [np.flatnonzero(x) for x in out]


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, factor: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest of all other ids, ties to the smaller id.

    Both tables have vec_id and embedding. A vector that is null, empty, zero, or holds a null or non-finite component
    takes no part, nor does a null id. Vectors of different lengths have no inner product: a query meets those of its own
    length. Rows that repeat an id count once, by the least of their vectors. Candidates of the query's own id are left
    out. Fewer candidates give fewer ranks; empty tables give no rows; other columns are ignored. Equal vectors are one in
    the index, by their k + 1 smallest ids, so a much repeated vector fills no shard. Work is dealt as pairs of one shard
    and one block of the queries routed to it, each bounded. Without a factor, the least of FACTORS is taken at which
    TRIAL_QUERIES of the queries, drawn by a hash, find TRIAL_RECALL of what exact search finds for them.
    """

    def valid(df: DataFrame) -> DataFrame:
        x = F.col("embedding")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists(x, lambda v: v != 0)
        rows = df.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double")).alias("embedding"))
        return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    spark = embeddings.sparkSession
    first = Window.partitionBy("embedding").orderBy("vec_id")
    kept = valid(embeddings).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    # at most k + 1 ids
    vectors = materialize(kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = materialize(valid(queries), "queries")
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)).alias("top")).orderBy("d").collect()
    parts = [_nearest(vectors.where(F.size("embedding") == r["d"]), asked.where(F.size("embedding") == r["d"]), r["n"], math.sqrt(r["top"]), k, factor) for r in sizes]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of a few queries by looking at every vector; each task keeps k for each query."""
    rows = asked.toPandas()
    few = vectors.sparkSession.sparkContext.broadcast((rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_list())))

    def best(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = few.value
        kept = None
        for pdf in batches:
            if not len(pdf):
                continue
            score = products(q, np.stack(pdf["embedding"].to_list()))
            # k + 1 vectors, and their equals in score, hold the k nearest ids besides the query's own
            least = np.partition(score, -min(k + 1, score.shape[1]), axis=1)[:, -min(k + 1, score.shape[1])]
            who, col = np.nonzero(score >= least[:, None])
            here = pd.DataFrame({"query_id": ids[who], "vec_id": pdf["ids"].to_numpy()[col], "score": score[who, col]}).explode("vec_id").astype({"vec_id": "int64"})
            here = here[here["query_id"] != here["vec_id"]]
            kept = best(here if kept is None else pd.concat([kept, here]))
        if kept is not None:
            yield kept

    each = vectors.select("embedding", "ids").mapInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _nearest(vectors: DataFrame, asked: DataFrame, n: int, top: float, k: int, factor: float | None) -> DataFrame:
    """(query_id, vec_id, score): of each query's k nearest in each shard that it is routed to."""
    search, parts = _index(vectors, n, top, k)
    return search(asked, choose_factor(vectors, asked, search, k) if factor is None else factor, parts)


def choose_factor(vectors: DataFrame, asked: DataFrame, search: Callable[[DataFrame, float, int], DataFrame], k: int) -> float:
    """The least of FACTORS that reaches TRIAL_RECALL on a bounded sample of the queries."""
    trial = materialize(asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIAL_QUERIES), "trial")
    if trial.isEmpty():
        return FACTORS[0]
    truth = materialize(exact(vectors, trial, k), "truth")
    total, chosen = truth.count(), FACTORS[-1]
    for f in FACTORS[:-1]:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = search(trial, f, 1).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
        if found.join(truth, ["query_id", "vec_id"], "left_semi").count() >= TRIAL_RECALL * total:
            chosen = f
            break
    discard(trial, truth)
    return chosen


def _index(vectors: DataFrame, n: int, top: float, k: int) -> tuple[Callable[[DataFrame, float, int], DataFrame], int]:
    """A search over trees that are built here: of (queries, factor, tasks for each shard and block); and how many shards a leaf has."""
    leaves = min(LEAVES, -(-n // SHARD_ROWS))
    parts = -(-n // (leaves * SHARD_ROWS))
    sample = vectors.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE_ROWS).toPandas()
    shards = Shards(np.stack(sample["embedding"].to_list()), top, leaves)
    shared = vectors.sparkSession.sparkContext.broadcast(shards)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_list())
                leaf, d = shared.value.place(x, np.sqrt(np.maximum(top * top - (x**2).sum(1), 0)))
                yield pdf.assign(leaf=leaf, d=list(d))

    placed = vectors.mapInPandas(place, "embedding array<double>, ids array<long>, leaf long, d array<double>")
    placed = materialize(placed.withColumn("part", F.pmod(F.xxhash64("embedding"), F.lit(parts))), "placed")
    ends = [f(F.col("d")[i]).alias(f"{f.__name__}{i}") for i in range(len(shards.vantage)) for f in (F.min, F.max)]
    lo, hi = (np.full((len(shards.paths), len(shards.vantage)), x) for x in (np.inf, -np.inf))
    for r in placed.groupBy("leaf").agg(F.count("*").alias("rows"), *ends).collect():
        for i in range(len(shards.vantage)):
            lo[r["leaf"], i], hi[r["leaf"], i] = r[f"min{i}"], r[f"max{i}"]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["ids"].to_list(), np.stack(pdf["embedding"].to_list()), top)
        return pd.DataFrame({"shard": [pdf["leaf"].iloc[0]], "tree": [pickle.dumps(tree, 5)]})

    # about SHARD_ROWS vectors
    trees = materialize(placed.select("embedding", "ids", "leaf", "part").groupBy("leaf", "part").applyInPandas(grow, "shard long, tree binary"), "trees")
    discard(placed)

    return lambda asked, factor, tasks: _search(asked, shared, trees, lo, hi, k, factor, tasks), parts


def _search(asked: DataFrame, shared: Broadcast, trees: DataFrame, lo: np.ndarray, hi: np.ndarray, k: int, factor: float, tasks: int) -> DataFrame:
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                to = shared.value.routes(np.stack(pdf["embedding"].to_list()), k + 1, factor, lo, hi)
                yield pdf.assign(leaf=to).explode("leaf").astype({"leaf": "int64"})

    routed = materialize(asked.mapInPandas(route, "vec_id long, embedding array<double>, leaf long"), "routed")
    blocks = routed.groupBy(F.col("leaf").alias("l")).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    # LEAVES rows at most
    routed = routed.join(F.broadcast(blocks), F.col("leaf") == F.col("l")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "asked": [pickle.dumps((pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_list())), 5)]})

    # about BLOCK_ROWS queries
    work = routed.select("vec_id", "embedding", "leaf", "block").groupBy("leaf", "block").applyInPandas(pack, "leaf long, asked binary")
    work = materialize(work, "blocks")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, i in zip(pdf["tree"], pdf["asked"], strict=True):
                tree: Tree = pickle.loads(t)
                ids, q = pickle.loads(i)
                for a in range(0, len(ids), 512):
                    own = ids[a : a + 512]
                    row, score = tree.search(q[a : a + 512], k + 1, factor)
                    who, col = np.nonzero(np.isfinite(score))
                    row, score = row[who, col], score[who, col]
                    count = np.diff(tree.id_at)[row]
                    at = np.repeat(tree.id_at[row] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                    out = pd.DataFrame({"query_id": np.repeat(own[who], count), "vec_id": tree.ids[at], "score": np.repeat(score, count)})
                    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                    yield out.groupby("query_id").head(k)

    # one pair of a tree and a block at a time
    pairs = work.join(trees, F.col("leaf") == F.col("shard")).select("asked", "tree")
    return pairs.repartition(max(1, work.count() * tasks)).mapInPandas(find, "query_id long, vec_id long, score double")
