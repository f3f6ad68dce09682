"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are multiplied: the likelihood of the page's main text under byte-trigram counts of documents of
known language; the likelihood of the language that the markup declares, as P(declared | language) over all pages; and a
prior of the page's host, smoothed towards its domain, that towards its address suffix, and that towards all pages. The
tables of the last two are grouped aggregates of the languages' probabilities, without the page's own part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.html import Page
from tessera.llm.storage import materialize

#: Hash places of byte trigrams; how much of a page's trigram evidence counts, since neighbouring trigrams overlap; the strength of a parent's prior.
PLACES, TEMPER, STRENGTH = 1 << 15, 0.25, 5.0
_DECLARED = re.compile(rb"<(?:html|body)\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_META = re.compile(rb"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)


def trigrams(blob: bytes) -> np.ndarray:
    """Hash places of the byte trigrams of the text with A-Z in lower case and white space as single spaces."""
    b = np.frombuffer(b" " + b" ".join(blob.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    x = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(17)).astype(np.int64)


def learn(documents: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probability of each place in each language, from all documents of those languages: partial sums in each task, then a grouped sum of at most languages x PLACES rows."""
    names = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), PLACES), np.int64)
        for batch, blobs in W.chunks(batches, "text"):
            for lang, b in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), blobs, strict=True):
                counts[names[lang]] += np.bincount(trigrams(b), minlength=PLACES)
        k, p = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(counts[k, p])], names=["k", "p", "n"])

    got = documents.where(F.col("lang").isin(languages)).select("lang", "text").mapInArrow(run, "k int, p int, n long").groupBy("k", "p").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), PLACES), 0.5)
    counts[got["k"], got["p"]] += got["n"]
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _normal(logs: Column, n: int) -> Column:
    """Probabilities from log weights."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sum(column: Column, n: int) -> Column:
    return F.array(*(F.sum(column[k]) for k in range(n)))


def evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """page_id, url, declared (lower case, first subtag), text_logs (log likelihood of each language), for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("declared", T.StringType()), T.StructField("text_logs", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_place = shared.value
        for batch, blobs in W.chunks(batches, "html"):
            declared, logs = [], np.zeros((len(blobs), by_place.shape[1]))
            for d, b in enumerate(blobs):
                found = _DECLARED.search(b) or _META.search(b)
                declared.append(found[1].decode().lower() if found else None)
                counts = np.bincount(trigrams(Page(b.decode("utf-8", "replace")).main_text().encode()), minlength=PLACES)
                seen = np.flatnonzero(counts)
                logs[d] = TEMPER * (counts[seen] @ by_place[seen].astype(float))
            ends = np.arange(len(blobs) + 1, dtype=np.int32) * logs.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")).cast(pa.string()), pa.array(declared, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(logs.reshape(-1)))], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, url, host, declared, text_lang, lang, probability for every row; the languages are those of documents.

    A page without text is judged by its markup and host; one without a declared language or host by the rest (a null or
    unreadable address counts as the empty host). A declared language that no document has counts as one other kind.
    Ties go to the first language by name. Without documents of known language lang is null. Repeated rows each appear; an
    empty table gives no rows; other columns are ignored.
    """
    # languages are a few hundred in the widest crawls; each takes PLACES counts in a worker
    languages = sorted(r["lang"] for r in documents.where(F.col("lang").isNotNull()).select("lang").distinct().collect())
    n = len(languages)
    address = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    if not n:
        return pages.select("page_id", "url", host.alias("host"), *(F.lit(None).cast("string").alias(c) for c in ("declared", "text_lang", "lang")), F.lit(None).cast("double").alias("probability"))
    names = F.array(*(F.lit(x) for x in languages))
    rows = materialize(evidence(pages, learn(documents, languages)), "evidence")
    kind = F.when(F.col("declared").isNull(), "(none)").when(F.col("declared").isin(languages), F.col("declared")).otherwise("(other)")
    rows = rows.withColumn("host", host).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("kind", kind)
    rows = rows.withColumn("text_p", _normal(F.col("text_logs"), n))
    # P(declared kind | language): languages + 2 rows
    kinds = {r["kind"]: r["s"] for r in rows.groupBy("kind").agg(_sum(F.col("text_p"), n).alias("s")).collect()}
    totals = [sum(s[k] for s in kinds.values()) for k in range(n)]
    logs = F.lit(None).cast("array<double>")
    for name, s in sorted(kinds.items()):
        of = F.array(*(F.lit(float(np.log((s[k] + 0.1) / (totals[k] + 0.1 * (n + 2))))) for k in range(n)))
        logs = F.when(F.col("kind") == name, of).otherwise(logs)
    rows = rows.withColumn("both_logs", F.zip_with("text_logs", logs, lambda a, b: a + b))
    rows = materialize(rows.withColumn("p", _normal(F.col("both_logs"), n)).select("page_id", "url", "host", "domain", "suffix", "declared", "text_p", "both_logs", "p"), "pages")
    hosts = rows.groupBy("host", "domain", "suffix").agg(_sum(F.col("p"), n).alias("host_s"))
    domains = hosts.groupBy("domain").agg(_sum(F.col("host_s"), n).alias("domain_s")).withColumnRenamed("domain", "d")
    suffixes = hosts.groupBy("suffix").agg(_sum(F.col("host_s"), n).alias("suffix_s")).withColumnRenamed("suffix", "s")
    every = F.array(*(F.lit(float(x)) for x in totals))
    table = hosts.join(domains, F.col("domain") == F.col("d")).join(suffixes, F.col("suffix") == F.col("s")).select(F.col("host").alias("h"), "host_s", "domain_s", "suffix_s")
    rows = rows.join(table, F.col("host") == F.col("h"))

    def smoothed(sums: Column, parent: Column) -> Column:
        """(sums without the page's own part + STRENGTH * parent) / their total"""
        raw = F.zip_with(F.zip_with(sums, "p", lambda a, b: F.greatest(F.lit(0.0), a - b)), parent, lambda a, b: a + F.lit(STRENGTH) * b)
        return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))

    total = F.lit(float(sum(totals) + n))
    rows = rows.withColumn("prior", F.transform(every, lambda x: (x + F.lit(1.0)) / total))
    for level in ("suffix_s", "domain_s", "host_s"):
        rows = rows.withColumn("prior", smoothed(F.col(level), F.col("prior")))
    rows = rows.withColumn("q", _normal(F.zip_with("both_logs", "prior", lambda a, b: a + F.log(b)), n))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return rows.select("page_id", "url", "host", "declared", best(F.col("text_p")).alias("text_lang"), best(F.col("q")).alias("lang"), F.array_max("q").alias("probability"))
