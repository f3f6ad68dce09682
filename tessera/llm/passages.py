"""Substring dedup by paragraph MinHash banding.

A text is seen at two grains. Its lines of 20 words and more, and blocks of shorter lines in a row, are paragraphs: min-max MinHash bands, as many as the wanted
recall needs, propose pairs; exact Jaccard similarity of their shingles confirms them. A passage may also sit inside
lines that differ elsewhere or break at other words, so texts are further seen as plain sequences of words: seeds chosen
by content (winnowing) lie in every window of `least_run` words, alike in every document, and the windows around seeds
that two documents share are compared whole. Links of lines form components; the paragraph, or window, in the smallest
doc_id stays, the others go.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.components import link, shared_keys
from tessera.llm.neardup import SETS, least_agreement, min_max_bands, sketches
from tessera.llm.storage import BROADCAST_IDS, beside, discard, materialize, shield

#: Words of a line (or a run of shorter lines) that is a paragraph, and of a seed.
LINE_WORDS, SEED_WORDS = 20, 10
#: Words of a block of a longer run of short lines, and between starts of blocks at least: so far apart, two blocks of a run are never 75 % similar.
BLOCK_WORDS, BLOCK_GAP = 40, 6
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LINES = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "text_key", "start", "n", "k1", "k2")] + [T.StructField("bands", T.ArrayType(T.LongType()))])
#: Signature values in a band, and in a sketch.
BAND_ROWS, SKETCH_VALUES = 4, 64
SEEDS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "text_key", "start", "h", "copy_of")])
WINDOWS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "text_key", "start", "h")])


def tuned_bands(percent: int, recall: float, values: int = BAND_ROWS) -> int:
    """The least number of bands of `values` signature values that finds pairs at the similarity with the recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** values)))


def _lines(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: the text's number, the first word's place in the text, and the count of words."""
    text, first, count = [], [], []
    for d, b in enumerate(blobs):
        at = 0
        for line in b.split(b"\n"):
            n = len(line.split())
            if n:
                text.append(d)
                first.append(at)
                count.append(n)
                at += n
    return np.array(text, np.int64), np.array(first, np.int64), np.array(count, np.int64)


def _block_starts(hashes: np.ndarray) -> list[int]:
    """Where blocks of a long run of short lines start: at its ends, and between them before words whose three-word hash is the least of BLOCK_GAP - 1 to either side, wherever lines break."""
    last = len(hashes) - BLOCK_WORDS
    key = W.mix64(hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(5))
    least = _sliding(key, 2 * BLOCK_GAP - 1, np.minimum)
    out = [0]
    for p in (np.flatnonzero(least == key[BLOCK_GAP - 1 : BLOCK_GAP - 1 + len(least)]) + BLOCK_GAP - 1).tolist():
        if out[-1] + BLOCK_GAP <= p <= last - BLOCK_GAP:
            out.append(p)
    return [*out, last]


def _paragraphs(hashes: np.ndarray, at: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all paragraphs: the text's number, the first word's place in the text, and the count of words."""
    text, first, count = _lines(blobs)
    if not len(text):
        return text, first, count
    long = count >= LINE_WORDS
    head = np.ones(len(text), bool)
    head[1:] = long[1:] | long[:-1] | (text[1:] != text[:-1])
    heads = np.flatnonzero(head)
    total = np.add.reduceat(count, heads)
    text, first, long = text[heads], first[heads], long[heads]
    split = ~long & (total >= BLOCK_WORDS + BLOCK_GAP)
    whole = (total >= LINE_WORDS) & ~split
    texts, firsts, counts = [text[whole]], [first[whole]], [total[whole]]
    for r in np.flatnonzero(split).tolist():
        begin = at[text[r]] + first[r]
        starts = np.array(_block_starts(hashes[begin : begin + total[r]]), np.int64)
        texts.append(np.full(len(starts), text[r]))
        firsts.append(first[r] + starts)
        counts.append(np.full(len(starts), BLOCK_WORDS))
    return np.concatenate(texts), np.concatenate(firsts), np.concatenate(counts)


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least.reduce of every `width` values in a row, in doubling steps."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def winnow(hashes: np.ndarray, at: np.ndarray, least_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of texts (words' hashes, where each text starts): of each window of `least_run` words, its runs of SEED_WORDS words with the least hash. The words of a window alone decide, so equal windows have equal seeds."""
    size = min(SEED_WORDS, least_run)
    span = least_run - size + 1
    if len(hashes) < least_run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = _rolled(hashes, np.arange(len(hashes) - size + 1), size)
    least = _sliding(value, span, np.minimum)
    inside = np.ones(len(least), bool)  # windows that lie in one text
    for end in at[1:-1].tolist():
        inside[max(0, end - least_run + 1) : end] = False
    pad = np.zeros(span - 1, np.uint64)
    best = _sliding(np.concatenate((pad, np.where(inside, least, np.uint64(0)), pad)), span, np.maximum)
    places = np.flatnonzero(best == value)
    return places, value[places]


def _rolled(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each start on."""
    out = np.full(len(starts), np.uint64(size), np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[starts + k]
    return W.mix64(out)


def _place() -> tuple[Column, Column]:
    """A row's doc_id (a null one comes last) and its text's hash, which together say where a text is: rows of one id or of none are told apart."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.xxhash64("text")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("own_id", "own_key"))


def _keyed(documents: DataFrame, *more: str) -> DataFrame:
    own_id, own_key = _place()
    return documents.select("text", *more, own_id.cast("long").alias("own_id"), own_key.alias("own_key"))


def seeds(documents: DataFrame, least_run: int) -> DataFrame:
    """The seeds of texts (doc_id, text, copy_of). A text that copies a smaller doc_id has one row, with its count of words as start, instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            hashes, at = W.word_hashes(blobs)
            ids, keys = _columns(batch)
            column = batch.column(batch.schema.get_field_index("copy_of"))
            is_copy = column.is_valid().to_numpy(zero_copy_only=False)
            places, values = winnow(hashes, at, least_run)
            owner = np.searchsorted(at, places, "right") - 1
            live = ~is_copy[owner]
            places, values, owner = places[live], values[live], owner[live]
            whole = np.flatnonzero(is_copy & (np.diff(at) >= least_run))
            rows = np.concatenate((owner, whole))
            start = np.concatenate((places - at[:-1][owner], np.diff(at)[whole]))
            h = np.concatenate((values.view(np.int64), np.zeros(len(whole), np.int64)))
            keeper = np.concatenate((np.zeros(len(owner), np.int64), column.fill_null(0).to_numpy(zero_copy_only=False)[whole]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids[rows], keys[rows], start, h)), pa.array(keeper, mask=np.arange(len(rows)) < len(owner))], names=SEEDS.names)

    return _keyed(documents, "copy_of").mapInArrow(run, SEEDS)


def seeded_windows(documents: DataFrame, marks: DataFrame, least_run: int) -> DataFrame:
    """The windows of `least_run` words that hold a marked seed (of_id, of_key, places), with their hashes. Marks grow with the texts, so they are met by a shuffle at every size."""
    chosen = _keyed(documents).join(marks, (F.col("own_id") == F.col("of_id")) & (F.col("own_key") == F.col("of_key")))
    reach = least_run - min(SEED_WORDS, least_run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            hashes, at = W.word_hashes(blobs)
            ids, keys = _columns(batch)
            owners, starts = [], []
            for d, places in enumerate(batch.column(batch.schema.get_field_index("places")).to_pylist()):
                if places:
                    at_word = np.unique(np.array(places, np.int64)[:, None] - np.arange(reach + 1))
                    at_word = at_word[(at_word >= 0) & (at_word <= at[d + 1] - at[d] - least_run)]
                    starts.append(at_word)
                    owners.append(np.full(len(at_word), d))
            owner, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, starts))
            h = _rolled(hashes, at[:-1][owner] + start, least_run)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[owner], keys[owner], start, h.view(np.int64))], names=WINDOWS.names)

    return chosen.select("text", "own_id", "own_key", "places").mapInArrow(run, WINDOWS)


def line_paragraphs(documents: DataFrame, width: int, bands: int) -> DataFrame:
    """Lines of LINE_WORDS words and more, and blocks of shorter ones, with their fingerprint and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            hashes, at = W.word_hashes(blobs)
            text, first, count = _paragraphs(hashes, at, blobs)
            begin = at[:-1][text] + first
            total = np.concatenate(([0], np.cumsum(count)))
            flat = hashes[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
            values, starts = W.distinct(*W.shingles(flat, total, width))
            ids, keys = _columns(batch)
            found = min_max_bands(values, starts, bands, BAND_ROWS) if len(text) else np.zeros((0, bands), np.int64)
            digests = [xxhash.xxh3_128_intdigest(values[starts[d] : starts[d + 1]].tobytes()) for d in range(len(text))]
            k1, k2 = (np.array([x >> s & (1 << 64) - 1 for x in digests], np.uint64).view(np.int64) for s in (64, 0))
            ends = np.arange(len(text) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[text], keys[text], first, count, k1, k2)] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))], names=LINES.names)

    return _keyed(documents).mapInArrow(run, LINES)


def line_sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, hashes, sketch) of wanted lines (rep doc_id, its text's key, start, n, node)."""
    # a text's own lines: as many as its words allow
    by_doc = wanted.groupBy("rep", "rep_key").agg(F.collect_list(F.struct("start", "n", "node")).alias("lines"))
    small = wanted.count() <= BROADCAST_IDS
    chosen = _keyed(documents).join(F.broadcast(by_doc) if small else by_doc, (F.col("own_id") == F.col("rep")) & (F.col("own_key") == F.col("rep_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            hashes, at = W.word_hashes(blobs)
            lines = batch.column(batch.schema.get_field_index("lines")).to_pylist()
            node, parts, signed = [], [], []
            for d in range(len(blobs)):
                for x in lines[d]:
                    own = hashes[at[d] + x["start"] : at[d] + x["start"] + x["n"]]
                    values, _ = W.distinct(*W.shingles(own, np.array([0, len(own)]), width))
                    node.append(x["node"])
                    parts.append(values.view(np.int64))
                    signed += sketches(values, np.array([0, len(values)]), SKETCH_VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(signed, pa.binary())], names=SETS.names)

    return chosen.select("lines", "text").mapInArrow(run, SETS)


def line_removals(documents: DataFrame, width: int, percent: int, recall: float) -> DataFrame:
    """(doc_id, text_key, start, n, keeper), written, of lines whose component has a smaller doc_id."""
    bands = tuned_bands(percent, recall)
    every = materialize(line_paragraphs(documents, width, bands), "lines")
    classes = every.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key", "start", "n")).alias("rep"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("k1", "k2", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_key"), F.col("rep.start").alias("start"), F.col("rep.n").alias("n"), "last", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    shared = shared_keys(classes.select(F.explode("bands").alias("key"), "node"))
    nodes = materialize(shared.select(F.col("node").alias("x")).distinct(), "nodes")
    wanted = materialize(classes.join(beside(nodes, 1), F.col("node") == F.col("x"), "left_semi").select("rep", "rep_key", "start", "n", "node"), "wanted")
    sets = materialize(line_sets(documents, wanted, width), "sets")
    found = link(shared, sets.select("node", "sketch"), sets, percent, least_agreement(percent, SKETCH_VALUES))
    discard(shared, nodes, wanted, sets)
    named = classes.select("k1", "k2", "rep", "last", "node").join(beside(found).withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left")
    # a class of one document without links loses nothing
    named = materialize(named.where("rep <> last or component is not null").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep", F.coalesce("component", "node").alias("component")), "named")
    least = materialize(named.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("keeper")), "least")
    keepers = materialize(named.join(beside(least), F.col("component") == F.col("c")).select("c1", "c2", "keeper"), "keepers")
    discard(classes, found, named, least)
    out = materialize(every.join(beside(keepers, 3), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).where("doc_id <> keeper").select("doc_id", "text_key", "start", "n", "keeper"), "line-removals")
    discard(every, keepers)
    return out


def _copies(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, text) with copy_of: the smallest doc_id of the same text, null where it is the row's own; and the table that says so."""
    own_id, own_key = _place()
    rows = documents.select(own_id.alias("id"), own_key.alias("t"), F.octet_length("text").alias("size")).where("size > 0")
    # a text of one document only is no copy
    first = materialize(rows.groupBy("t", "size").agg(F.min("id").alias("copy_of"), F.max("id").alias("last")).where("copy_of <> last").select(F.col("t").alias("t1"), F.col("size").alias("s1"), "copy_of"), "first-copies")
    copies = materialize(rows.join(beside(first, 3), (F.col("t") == F.col("t1")) & (F.col("size") == F.col("s1"))).where("id <> copy_of").select("id", "t", "copy_of").distinct(), "copies")
    discard(first)
    own = (own_id == F.col("id")) & (own_key == F.col("t"))
    return documents.select("doc_id", "text").join(beside(copies, 3, texts=True), own, "left").select("doc_id", "text", "copy_of"), copies


def window_removals(documents: DataFrame, least_run: int) -> DataFrame:
    """(doc_id, text_key, start, n, keeper), written, of all windows of `least_run` words that a smaller doc_id has too, joined up.

    Texts that copy a smaller doc_id's go as a whole. Two documents that share a window share its seeds, so the windows
    around shared seeds, which are few against all, have every shared window among them; they meet by their hashes.
    """
    marked, copies = _copies(documents)
    rows = materialize(seeds(marked, least_run), "seeds")
    discard(copies)
    copied = rows.where("copy_of is not null").select("doc_id", "text_key", F.lit(0).cast("long").alias("start"), F.col("start").alias("n"), F.col("copy_of").alias("keeper"))
    own = rows.where("copy_of is null")
    both = materialize(own.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select(F.col("h").alias("k")), "both")
    # a document's own seeds: as many as its words allow
    marks = materialize(own.join(beside(both, 1), F.col("h") == F.col("k"), "left_semi").groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.collect_set(F.col("start").cast("int")).alias("places")), "marks")
    windows = materialize(seeded_windows(documents, marks, least_run), "windows")
    discard(both, marks)
    first = materialize(windows.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper <> last").select(F.col("h").alias("k"), "keeper"), "first")
    hits = windows.join(beside(first), F.col("h") == F.col("k")).where("doc_id <> keeper")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "text_key", "start", "n", "keeper")])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, key, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                merged: list[list[int]] = []
                for start, keeper in sorted((p["start"], p["keeper"]) for p in parts):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = start + least_run
                        merged[-1][2] = min(keeper, merged[-1][2])
                    else:
                        merged.append([start, start + least_run, keeper])
                for start, end, keeper in merged:
                    for column, x in zip(out, (doc, key, start, end - start, keeper), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=schema.names)

    # a document's own windows: as many as its words allow
    out = materialize(copied.unionByName(hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "keeper")).alias("parts")).mapInArrow(runs, schema)), "window-removals")
    discard(rows, windows, first)
    return out


def without_passages(documents: DataFrame, width: int = 5, percent: int = 75, recall: float = 0.995, least_run: int = 24) -> DataFrame:
    """The documents with repeated passages taken out of text, and more columns: n_removed (words), spans (start word, end word, keeper doc_id).

    Other columns are as they were. A null text stays null; empty texts, short lines and texts that share nothing stay as
    they are. A passage stays in the smallest doc_id that has it; repeats within one document, and rows that share a
    doc_id, do not count against each other. A near-matched line or block goes whole, also the few words in it that the
    other lacks. A row of null doc_id counts as the last. A text that is wholly repeated
    becomes empty, and its row stays. An empty table gives no rows. Columns of documents that have the names of the new
    ones stay beside them.
    """
    lines = line_removals(documents, width, percent, recall)
    windows = window_removals(documents, least_run)
    both = materialize(lines.unionByName(windows), "removals")
    discard(lines, windows)
    # a document's spans: as many as its words allow
    spans = both.groupBy(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key")).agg(F.collect_list(F.struct("start", "n", "keeper")).alias("_found"))
    small = both.count() <= BROADCAST_IDS
    inner_documents, restore = shield(documents, ("doc_id", "text"))
    fields = list(inner_documents.schema.fields)
    schema = T.StructType([*fields, T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "keeper")])))])
    names = inner_documents.columns
    own_id, own_key = _place()
    joined = inner_documents.join(F.broadcast(spans) if small else spans, (own_id == F.col("span_id")) & (own_key == F.col("span_key")), "left")
    inner = schema["spans"].dataType
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in inner.elementType.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in W.chunks(batches, "text"):
            found = batch.column(batch.schema.get_field_index("_found")).to_pylist()
            column = batch.column(batch.schema.get_field_index("text"))
            texts, removed, spans_out = column.to_pylist(), [0] * len(blobs), [[] for _ in blobs]
            for d, parts in enumerate(found):
                if parts:
                    texts[d], spans_out[d] = take_out(blobs[d], [(p["start"], p["start"] + p["n"], p["keeper"]) for p in parts])
                    removed[d] = sum(s["end"] - s["start"] for s in spans_out[d])
            columns = [pa.array(texts, column.type) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(spans_out, arrow)], names=[*names, "n_removed", "spans"])

    return restore(joined.select(*names, "_found").mapInArrow(run, schema), "n_removed", "spans")


def take_out(blob: bytes, parts: list[tuple[int, int, int]]) -> tuple[str, list[dict]]:
    """The text without the words of the spans, which are merged; each takes the white space after it along."""
    merged: list[list[int]] = []
    for a, b, keeper in sorted(parts):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
            merged[-1][2] = min(keeper, merged[-1][2])
        else:
            merged.append([a, b, keeper])
    at = [m.start() for m in _WORD.finditer(blob)] + [len(blob)]
    kept, last = [], 0
    for a, b, _ in merged:
        kept.append(blob[last : at[a]])
        last = at[min(b, len(at) - 1)]
    kept.append(blob[last:])
    return b"".join(kept).decode("utf-8", "replace"), [{"start": a, "end": b, "keeper": k} for a, b, k in merged]
