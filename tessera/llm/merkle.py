"""Merkle trees over a range-sorted RDD, with a proof for every leaf.

A forest has one tree for each group. Its leaves are sorted by group and order into ranges, one for each partition. The
driver learns four numbers and two digests of each partition (the sizes of its first and last group), and so the place of
each partition's first leaf in its group. Every partition then builds the subtrees that it holds whole, and passes on
only the nodes at its ragged ends. These meet by coordinate (group, level, run), at most ARITY in each, level by level up
to the roots. Last, each partition gets the few runs on its left and right edge that it could not build, and proves its
leaves in one more pass over the same sorted RDD: leaves are shuffled once, by the sort.

Digests are lowercase hex text where they are hashed; within tasks they are kept as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.storage import discard, materialize

#: Children of a node (fixed value), and bytes and hex digits of a digest.
ARITY, BYTES, HEX = 16, 32, 64
#: Rows of a batch of results.
BATCH_ROWS = 2_000


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _ceil(n: int, m: int = ARITY) -> int:
    return -(-n // m)


def height(leaves: int) -> int:
    """Levels above the leaves."""
    h = 0
    while leaves > 1:
        leaves, h = _ceil(leaves), h + 1
    return h


def local_levels(start: int, leaves: bytes, total: int) -> list[tuple[int, bytes]]:
    """For each level, where its nodes start and the nodes: those whose leaves are all among `leaves`, which start at `start` in a group of `total`. Ends where none is complete, or at the root."""
    levels = [(start, leaves)]
    while total > 1 and leaves:
        end = start + len(leaves) // BYTES
        first, last = _ceil(start), _ceil(end) if end == total else end // ARITY
        runs = (leaves[max(0, r * ARITY - start) * BYTES : (r * ARITY + ARITY - start) * BYTES] for r in range(first, last))
        leaves = b"".join(hashlib.sha256(run.hex().encode()).digest() for run in runs)
        start, total = first, _ceil(total)
        levels.append((start, leaves))
    return levels


def _whole(levels: list[tuple[int, bytes]], level: int, run: int) -> bool:
    """Whether a run of this level was built here."""
    if level + 1 >= len(levels):
        return False
    start, nodes = levels[level + 1]
    return start <= run < start + len(nodes) // BYTES


def edge_runs(start: int, count: int, total: int, levels: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """(level, run) above leaves start..start+count of the runs that are not whole here: at most two of a level."""
    out = []
    for level in range(height(total)):
        runs = {start // ARITY ** (level + 1), (start + count - 1) // ARITY ** (level + 1)}
        out += [(level, r) for r in sorted(runs) if not _whole(levels, level, r)]
    return out


# the first pass: sizes of groups by partition


def _ends(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of a partition: number of groups, the first one's key and size, and the last one's."""
    n, first, last = 0, None, None
    for key, members in groupby(rows, key=lambda r: r[0]):
        last = (_token(key), sum(1 for _ in members))
        first, n = first or last, n + 1
    yield (n, first, last)


def _token(key: str | None) -> bytes:
    """A key's stand-in of fixed size."""
    return b"" if key is None else hashlib.sha256(key.encode()).digest()


def places(ends: list[tuple]) -> list[tuple[int, int, int]]:
    """For each partition: where its first group starts within that group, and the whole sizes of its first and its last group."""
    out, before = [(0, 0, 0)] * len(ends), {}
    for p, (n, first, last) in enumerate(ends):
        if n:
            out[p] = (before.get(first[0], 0), 0, 0)
            # a group that goes on from here is the last one of this partition
            before = {last[0]: (before.get(last[0], 0) if n == 1 else 0) + last[1]}
    after: dict = {}
    for p in range(len(ends) - 1, -1, -1):
        n, first, last = ends[p]
        if n:
            begun = out[p][0] if n == 1 else 0
            total_last = after.get(last[0], begun + last[1])
            total_first = total_last if n == 1 else out[p][0] + first[1]
            out[p] = (out[p][0], total_first, total_last)
            after = {first[0]: total_first}
    return out


def _groups(place: tuple[int, int, int], n_groups: int, rows: Iterable[tuple], first: int = 0) -> Iterator[tuple]:
    """key, start, total, leaves (bytes) and payloads of each group of a partition, of its group number `first` on."""
    for k, (key, members) in enumerate(groupby(rows, key=lambda r: r[0]), first):
        leaves, kept = bytearray(), []
        for _, leaf, *payload in members:
            leaves += leaf
            kept.append(payload)
        start = place[0] if k == 0 else 0
        total = place[1] if k == 0 else place[2] if k == n_groups - 1 else len(kept)
        yield key, start, total, bytes(leaves), kept


# the second pass: what partitions pass on, and what they ask for

_PASSED = "part long, key string, level int, pos long, digest string, total long, wanted boolean"


def _pass_on(part: int, groups: Iterable[tuple]) -> Iterator[tuple]:
    for key, start, total, leaves, kept in groups:
        levels = local_levels(start, leaves, total)
        for level, (first, nodes) in enumerate(levels):
            top = _ceil(total, ARITY**level) == 1
            for i in range(len(nodes) // BYTES) if top or level + 1 == len(levels) else _outside(first, len(nodes) // BYTES, levels[level + 1]):
                yield part, key, level, first + i, nodes[i * BYTES : (i + 1) * BYTES].hex(), total, False
        for level, run in edge_runs(start, len(kept), total, levels):
            yield part, key, level, run, None, total, True
        yield part, key, None, None, None, total, True


def _outside(first: int, count: int, above: tuple[int, bytes]) -> Iterator[int]:
    """Places of nodes whose run is not built here: all before and after those that are."""
    lo, hi = above[0] * ARITY - first, (above[0] + len(above[1]) // BYTES) * ARITY - first
    if hi <= lo:
        yield from range(count)
    else:
        yield from range(min(count, max(0, lo)))
        yield from range(min(count, hi), count)


def finish_levels(nodes: DataFrame, levels: int) -> tuple[DataFrame | None, DataFrame, list[DataFrame]]:
    """From passed-on nodes (key, level, pos, digest, total): the runs met on the way (key, level, run, children), each group's root (key, root), and the tables written for them. levels: of the tallest group that is cut."""
    columns = ["key", "level", "pos", "digest", "total"]
    is_root = F.ceil(F.col("total") / F.pow(F.lit(float(ARITY)), F.col("level"))) == 1
    roots, runs, here = [nodes.where(is_root)], [], nodes.where((F.col("level") == 0) & ~is_root).select(columns)
    for level in range(levels):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), "")
        # at most ARITY nodes
        met = here.groupBy("key", "total", F.floor(F.col("pos") / ARITY).alias("run")).agg(children.alias("children"))
        runs.append(materialize(met.withColumn("level", F.lit(level)), "merkle-runs"))
        up = runs[-1].select("key", F.lit(level + 1).alias("level"), F.col("run").alias("pos"), F.sha2("children", 256).alias("digest"), "total")
        roots.append(up.where(is_root))
        here = nodes.where((F.col("level") == level + 1) & ~is_root).select(columns).union(up.where(~is_root))
    every = reduce(DataFrame.union, (r.select("key", "level", "run", "children") for r in runs)) if runs else None
    return every, reduce(DataFrame.union, (r.select("key", F.col("digest").alias("root")) for r in roots)), runs


# the third pass: proofs


def paths(start: int, total: int, leaves: bytes, known: dict[tuple[int, int], str]) -> Iterator[list[tuple[int, str]]]:
    """For each leaf, (its place among them, hex digests of the children) of each run on its way to the root. known: children by (level, run) of runs that were not built here."""
    levels, h = local_levels(start, leaves, total), height(total)

    def children(level: int, run: int) -> str:
        if _whole(levels, level, run):
            first, nodes = levels[level]
            return nodes[(run * ARITY - first) * BYTES : (run * ARITY + ARITY - first) * BYTES].hex()
        return known[level, run]

    above: list = []
    for x in range(start, start + len(leaves) // BYTES):
        if x == start or x % ARITY == 0:  # leaves of one run share all but their own place
            run = x // ARITY
            own = children(0, run) if h else ""
            above = [((x // ARITY**level) % ARITY, children(level, x // ARITY ** (level + 1))) for level in range(1, h)]
        yield [(x % ARITY, own), *above] if h else []


def siblings(path: Iterable[tuple[int, str]]) -> list[str]:
    """By level, the others of the run, left to right, as one text."""
    return [c[: i * HEX] + c[(i + 1) * HEX :] for i, c in path]


def fold(leaf: str, path: Iterable[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for i, c in path:
        leaf = digest_of(c[: i * HEX] + leaf + c[(i + 1) * HEX :])
    return leaf


def forest(rows: DataFrame, order: list[str], payload: list[str], schema: str, emit: Callable, above: Callable[[DataFrame], tuple[DataFrame, list[DataFrame]]] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """One tree for each group of rows (key string, leaf binary, further columns), leaves sorted by key, null first, then order.

    emit(root, leaf, path, payload, more) makes a row of `schema` for each leaf: path as in paths(), payload the values
    of those columns, more what `above` says of the group. above: from roots (key, root) to rows of (key, more), and the
    written tables that they read. Returned are the rows, lazily, and the written tables that these read.
    """
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    # one RDD for all passes: its ranges are drawn once, and its shuffle is read again
    ranged = rows.orderBy(F.col("key").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)).select("key", "leaf", *payload).rdd.map(tuple)
    ends = ranged.mapPartitions(_ends).collect()  # one small row of each partition
    found = places(ends)
    place = sc.broadcast([(x, e[0]) for x, e in zip(found, ends, strict=True)])

    def groups(part: int, part_rows: Iterable[tuple]) -> Iterator[tuple]:
        at, n = place.value[part] if part < len(place.value) else ((0, 0, 0), 0)
        return _groups(at, n, part_rows)

    passed = materialize(spark.createDataFrame(ranged.mapPartitionsWithIndex(lambda p, it: _pass_on(p, groups(p, it))), _PASSED, verifySchema=False), "merkle-passed")
    # a group that is cut is the first or the last of its partitions
    levels = max((height(t) for at in found for t in at[1:]), default=0)
    runs, roots, written = finish_levels(passed.where("not wanted"), levels)
    roots = materialize(roots, "merkle-roots")
    more, more_written = above(roots) if above else (roots.select("key", F.lit(None).cast("string").alias("more")), [])
    told = roots.join(more.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k"))).select("key", "root", "more")
    asked = passed.where("wanted")
    none = F.lit(None).cast(told.schema["more"].dataType).alias("more")
    of_groups = asked.where("level is null").alias("a").join(told.alias("t"), F.expr("a.key <=> t.key")).select("part", "a.key", "a.level", "a.pos", F.col("root").alias("digests"), "more")
    answers = of_groups
    if runs is not None:
        of_runs = asked.where("level is not null").alias("a").join(runs.alias("r"), F.expr("a.key <=> r.key and a.level = r.level and a.pos = r.run"))
        answers = of_groups.union(of_runs.select("part", "a.key", "a.level", "a.pos", F.col("children").alias("digests"), none))
    answers = materialize(answers, "merkle-answers")
    discard(passed, roots, *written, *more_written)
    told_leaves = ranged.mapPartitionsWithIndex(lambda p, it: ((p, i, *r) for i, r in enumerate(it)))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in payload)
    leaves = spark.createDataFrame(told_leaves, f"part long, place long, key string, leaf binary, {kinds}", verifySchema=False)
    # answers come before the leaves of their range
    both = leaves.unionByName(answers, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.col("place").asc_nulls_first())
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []  # leaves of one group of one range
        part, known, tops = None, {}, {}

        def proven() -> Iterator[pa.RecordBatch]:
            at, n = place.value[part]
            keys = [r["key"] for r in waiting]
            packed = ((k, r["leaf"], [r[c] for c in payload]) for k, r in zip(keys, waiting, strict=True))
            for key, start, total, digests, kept in _groups(at, n, packed, group):
                root, extra = tops[key]
                made = []
                for i, path in enumerate(paths(start, total, digests, known.get(key, {}))):
                    made.append(emit(root, digests[i * BYTES : (i + 1) * BYTES].hex(), path, kept[i][0], extra))
                    if len(made) == BATCH_ROWS:
                        yield _batch(made, arrow)
                        made = []
                yield _batch(made, arrow)

        group = 0
        for batch in batches:
            for r in batch.to_pylist():
                new = r["part"] != part
                if waiting and (new or (r["place"] is not None and r["key"] != waiting[0]["key"])):
                    yield from proven()
                    waiting, group = [], group + 1
                if new:
                    part, known, tops, group = r["part"], {}, {}, 0
                if r["place"] is not None:
                    waiting.append(r)
                elif r["level"] is None:
                    tops[r["key"]] = (r["digests"], r["more"])
                else:
                    known.setdefault(r["key"], {})[r["level"], r["pos"]] = r["digests"]
        if waiting:
            yield from proven()

    return both.mapInArrow(prove, out), [answers]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [() for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# documents


def encoded(c: str | Column) -> Column:
    """A value as -, if null, or its UTF-8 bytes after their number and a colon."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(text if c == "text" else c) for c in FIELDS)), 256))


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def to_be_tampered() -> Column:
    """One row in five, by its doc_id; none without one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


_TOP = "key string, root string, path array<struct<slot:int,children:string>>"


def _top(roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The tree over the groups' roots, in the order of their keys."""
    rows = roots.select(F.lit(None).cast("string").alias("key"), F.unhex("root").alias("leaf"), F.col("key").alias("source"))
    out, written = forest(rows, ["source"], ["source"], _TOP, lambda root, leaf, path, kept, _: (kept[0], root, [{"slot": i, "children": c} for i, c in path]))
    return out.select("key", F.struct("root", "path").alias("more")), written


def _proven(documents: DataFrame, changed: Column, schema: str, emit: Callable) -> DataFrame:
    rows = documents.select("doc_id", F.col("source").cast("string").alias("key"), leaf_of(F.col("text")).alias("leaf"), changed.alias("changed"))
    rows = materialize(rows, "merkle-leaves")  # texts are read once
    return forest(rows, ["doc_id", "leaf"], ["doc_id", "changed"], schema, emit, _top)[0]


def _id_type(documents: DataFrame) -> str:
    return documents.schema["doc_id"].dataType.simpleString()


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, source_root, root, leaf and the proof of every document: slots (its node's place in each run on the way to the root) and siblings (the others of each run, left to right).

    documents: doc_id, source, lang, n_chars, text; other columns are ignored. Nulls are hashed as such; rows with a null
    source are one group, the first. Leaves of a source ascend by doc_id, null first, rows of one doc_id by hash;
    repeated rows are leaves of their own. Without rows there is no root and the result is empty.
    """

    def emit(root: str, leaf: str, path: list, kept: list, top) -> tuple:
        every = [*path, *((x["slot"], x["children"]) for x in top["path"])]
        return kept[0], leaf, root, top["root"], [i for i, _ in every], siblings(every)

    none = F.lit(None).cast("binary")
    return _proven(documents, none, f"doc_id {_id_type(documents)}, leaf string, source_root string, root string, slots array<int>, siblings array<string>", emit)


def audit(documents: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every document: folded_root is what its siblings lead to from the leaf with `text` in place of its own where `tampered` is true. Rows as in manifest()."""

    def emit(root: str, leaf: str, path: list, kept: list, top) -> tuple:
        every = [*path, *((x["slot"], x["children"]) for x in top["path"])]
        folded = fold(leaf if kept[1] is None else bytes(kept[1]).hex(), every)
        return kept[0], leaf, root, top["root"], digest_of("".join(siblings(every))), folded, folded == top["root"]

    changed = F.when(tampered, leaf_of(text))
    return _proven(documents, changed, f"doc_id {_id_type(documents)}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", emit)
