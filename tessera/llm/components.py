"""Connected components and candidate linking over tables; nothing of document size reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import beside, discard, materialize

#: Up to so many edges (16 bytes each) are joined up by one task; beyond, by rounds over all executors.
ONE_TASK_EDGES = 1_000_000
#: Nodes in a block of a large key; nodes, and hashes of 8 bytes, in a home of nodes whose sets travel together.
BLOCK, HOME, HOME_HASHES = 48, 128, 1 << 16


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
    return row["n"], row["h"]


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task, by path halving."""
    parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate([p[k] for p in parts]) for k in range(2))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # a root is smaller than what hangs on it
        root[x] = root[root[x]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(root)])], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), written; the component is its smallest node.

    Few edges are joined up by one task. Beyond `one_task` of them, the large-star and small-star steps alternate until
    the edges are stars; each step writes its edges to the shared folder. Nodes of many edges meet only in min()
    aggregates, which combine before the shuffle, and in joins that Spark can split.
    """
    now = materialize(edges.select("a", "b"), "edges")
    if now.count() <= one_task:
        out = materialize(now.coalesce(1).mapInArrow(_join_up, "node long, component long"), "components")
        discard(now)
        return out
    first, now = now, materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    discard(first)
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        top = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(top.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, materialize(small.union(top).where("a <> b").distinct(), "edges")
        before, state = state, _state(now)
        discard(last)
        if state == before:
            break
    out = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out = materialize(out, "components")
    discard(now)
    return out


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, node, hub) of keys (key, node) that two nodes or more have, written; the hub is the key's smallest node. Keys are shuffled once, at every size, as rows of two numbers."""
    own = Window.partitionBy("key")
    both = keys.select("key", "node", F.min("node").over(own).alias("hub"), F.max("node").over(own).alias("last"))
    return materialize(both.where("hub <> last").select("key", "node", "hub"), "keys")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), written, whose full sets have 100 * intersection >= percent * union. A set of many pairs is joined in a way that Spark can split."""
    pairs = materialize(pairs, "pairs")
    ends = materialize(pairs.select(F.col("b").alias("n")).distinct(), "ends")
    one = sets.join(beside(pairs, texts=True), F.col("node") == F.col("a")).select("a", "b", F.col("hashes").alias("ha"))
    two = sets.join(beside(ends, 1, texts=True), F.col("node") == F.col("n"), "left_semi").select(F.col("node").alias("nb"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    out = materialize(one.join(two, F.col("b") == F.col("nb")).where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b").distinct(), "links")
    discard(pairs, ends)
    return out


def _homes(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, home), written: nodes with the same least hub share a home, of about HOME nodes and HOME_HASHES hashes at most (one set at least)."""
    weights = sets.select(F.col("node").alias("w"), F.size("hashes").alias("hashes"))
    own = materialize(shared.groupBy("node").agg(F.min("hub").alias("family")).join(weights, F.col("node") == F.col("w")).select("node", "family", "hashes"), "families")
    parts = F.greatest(F.ceil(F.count("*") / HOME), F.ceil(F.sum("hashes") / HOME_HASHES))
    sizes = materialize(own.groupBy(F.col("family").alias("f")).agg(parts.alias("parts")), "sizes")
    out = materialize(own.join(beside(sizes), F.col("family") == F.col("f")).select("node", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("home")), "homes")
    discard(own, sizes)
    return out


def _candidates(left: DataFrame, sketches: DataFrame, homes: DataFrame, agree: int) -> DataFrame:
    """(h1, h2, xs, ys): lists of pairs, by their homes, that share a key, are of different components and whose sketches agree in `agree` bytes or more. Nodes of a key are dealt into blocks, and each pair of blocks is one row of work."""
    sizes = materialize(left.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    known = sketches.withColumnRenamed("node", "n").join(homes.withColumnRenamed("node", "m"), F.col("n") == F.col("m")).select("n", "sketch", "home")
    rows = left.join(beside(sizes), F.col("key") == F.col("k")).join(known, F.col("node") == F.col("n"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block holds about BLOCK nodes
    packed = materialize(rows.groupBy("key", "block").agg(*(F.collect_list(c).alias(c) for c in ("node", "comp", "home", "sketch"))), "blocks")
    discard(sizes)
    one, two = (packed.select(*(F.col(c).alias(c + x) for c in packed.columns)) for x in "12")
    work = one.join(two, (F.col("key1") == F.col("key2")) & (F.col("block1") <= F.col("block2")))
    lists = pa.list_(pa.int64())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], set[tuple[int, int]]] = {}
            for n1, c1, h1, s1, n2, c2, h2, s2 in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (s1, s2))
                near = (x[:, None, :] == y[None, :, :]).sum(2) >= agree
                near &= np.array(c1)[:, None] != np.array(c2)[None, :]
                for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                    (p, a), (q, b) = sorted(((h1[i], n1[i]), (h2[j], n2[j])))
                    out.setdefault((p, q), set()).add((a, b))
            ends = [(k, sorted(v)) for k, v in sorted(out.items())]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in ends], pa.int64()), pa.array([k[1] for k, _ in ends], pa.int64()), pa.array([[a for a, _ in v] for _, v in ends], lists), pa.array([[b for _, b in v] for _, v in ends], lists)], names=["h1", "h2", "xs", "ys"])

    names = [c + x for x in "12" for c in ("node", "comp", "home", "sketch")]
    return work.select(*names).mapInArrow(compare, "h1 long, h2 long, xs array<long>, ys array<long>")


def _confirm_lists(rows: DataFrame, sets: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the listed pairs; of each pair of homes, no more than join its nodes up. The sets of a home travel together, once for each other home that it meets."""
    rows = materialize(rows.groupBy("h1", "h2").agg(F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ys")).alias("ys")), "candidates")
    met = rows.select(F.col("h1").alias("h")).union(rows.select("h2")).distinct()
    housed = sets.join(homes.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).join(met, F.col("home") == F.col("h"), "left_semi")
    # a home holds about HOME nodes
    housed = materialize(housed.groupBy("home").agg(F.collect_list("node").alias("nodes"), F.collect_list("hashes").alias("sets")), "homes")
    one, two = (housed.select(*(F.col(c).alias(c + x) for c in housed.columns)) for x in "12")
    work = rows.join(one, F.col("h1") == F.col("home1")).join(two, F.col("h2") == F.col("home2")).select("xs", "ys", "nodes1", "sets1", "nodes2", "sets2")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                xs, ys = (batch.column(k)[i].as_py() for k in (0, 1))
                own: dict[int, np.ndarray] = {}
                for n, v in ((2, 3), (4, 5)):
                    column = batch.column(v)[i].values
                    own.update((node, np.sort(column[k].values.to_numpy())) for k, node in enumerate(batch.column(n)[i].as_py()))
                root: dict[int, int] = {}

                def top(x: int, root: dict[int, int] = root) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = x = root[root[x]]
                    return x

                for x, y in sorted(set(zip(xs, ys, strict=True))):
                    p, q, tx, ty = own[x], own[y], top(x), top(y)
                    if tx == ty or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                        continue
                    at = np.searchsorted(p, q)
                    both = int(np.count_nonzero(p[np.minimum(at, len(p) - 1)] == q))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        root[max(tx, ty)] = min(tx, ty)
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return work.mapInArrow(check, "a long, b long")


def link(shared: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, agree: int) -> DataFrame:
    """(node, component) of the nodes that links join, written; others are absent.

    shared: shared_keys(), where nodes that share a key are candidates. sketches: (node, sketch), bytes of the signature.
    sets: (node, hashes), on which a link is confirmed. All pairs that share a key are settled, without emitting those of
    a large group: first each node of a key is tested against the key's hub; nodes of one component then need no test.
    Nodes of keys that still hold several components are compared by their sketches in blocks, and the pairs of different
    components that agree enough for a link are confirmed on the sets, as lists between blocks of nodes.
    """
    links = confirm(shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), sets, percent)
    found = components(links)
    discard(links)
    labels = materialize(shared.join(beside(found).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "labels")
    mixed = materialize(labels.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k"), "mixed")
    left = materialize(labels.join(beside(mixed, 1), F.col("key") == F.col("k"), "left_semi").select("key", "node", "comp"), "left")
    discard(labels, mixed)
    if left.isEmpty():
        discard(left)
        return found
    homes = _homes(shared, sets)
    more = materialize(_confirm_lists(_candidates(left, sketches, homes, agree), sets, homes, percent), "links")
    out = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    discard(left, homes, found, more)
    return out
