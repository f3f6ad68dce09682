"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.mixing import mixed_documents
from tessera.llm.neardup import one_of_each
from tessera.llm.packing import pack
from tessera.llm.passages import without_passages
from tessera.llm.quality import keep_documents
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.storage import discard, materialize, shield
from tessera.session import reach_workers


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep, as they are. A null or empty text fails the base rules; rows that repeat are judged alike and stay or go together; an empty table stays empty."""
    return keep_documents(docs, table(reach_workers(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, a null one last, of equal ones that of the least text hash. Texts that are null, empty or white space are no duplicates and all stay; an empty table stays empty."""
    reach_workers(spark)
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id has; n_chars, if there is such a column, counts what is left where something was taken out. A null doc_id counts as the last; rows that share a doc_id do not count against each other; null and empty texts stay; an empty table stays empty. Columns named like the operator's own stay as they are."""
    reach_workers(spark)
    # other columns go by names of their own, so that none is taken for the operator's
    inner, restore = shield(docs, ("doc_id", "text", "n_chars"))
    out = without_passages(inner)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restore(out)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring the domains' token totals to their target weights: a row as often as it is drawn, or not at all. A null or empty text has no tokens and a rate of its own; rows that repeat are drawn alike; an empty table stays empty."""
    return mixed_documents(docs, table(reach_workers(spark), sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths. A null text counts as the empty one, which has its end token; rows that repeat are packed each; an empty table gives no pieces."""
    reach_workers(spark)
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", passages), ("mixing", mixing), ("packing", packing)]
#: SQL has no form for these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
            if k:
                discard(before)  # written by the stage before, and read by none to come
    return docs
