"""The registered queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; a cluster has it at the same place on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.langid import identify

    return identify(table(spark, root, "pages"), table(spark, root, "documents"))


def op2_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.scoring import score

    return score(table(spark, root, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.quality import verdicts

    return verdicts(table(spark, root, "documents"), table(spark, root, "labels"))


def op4_nearest_neighbours(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.vptree import nearest

    vectors = table(spark, root, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_mixing(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, root, "documents"), table(spark, root, "labels"))


def op6_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.passages import without_passages

    return without_passages(table(spark, root, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, root, "documents"), tokenizer_path())


def op8_html_extraction(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.html import main_texts

    return main_texts(table(spark, root, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.neardup import near_duplicates

    return near_duplicates(table(spark, root, "documents"))


def op10_sharding(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, root, "documents"), [1.0] * 24)


def op11_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.chat import formatted_digests

    return formatted_digests(spark, table(spark, root, "conversations"))


def op12_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    from tessera.llm.trie import prefix_trie

    return prefix_trie(table(spark, root, "conversations"))


def op13_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.merkle import audit, lowered, to_be_tampered

    return audit(table(spark, root, "documents"), to_be_tampered(), lowered(F.col("text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_lm_scoring, op3_quality_rules, op4_nearest_neighbours, op5_mixing, op6_substring_dedup, op7_packing, op8_html_extraction, op9_minhash_near_dedup, op10_sharding, op11_chat_formatting, op12_prefix_trie, op13_merkle_manifest)}


#: The checksum is worked out bytewise from its polynomial. Of equal weights the least -ln(u) is the greatest u, which is the greatest hex digits.
SHARDING_SQL = """
WITH bits AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
raw AS (SELECT row_number() OVER () AS i, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x, list_transform(range(25), lambda s: substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s), 1, 12)) AS draws FROM documents),
summed AS (SELECT i, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(n), lambda p: CAST('0x' || substr(x, 2 * p + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM raw, bits),
placed AS (SELECT doc_id, CAST(n + 8 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, substr(md5(k || ':' || text_crc32), 1, 3) AS part, CAST(list_position(draws[:24], list_max(draws[:24])) - 1 AS INTEGER) AS shard, CAST(list_position(draws, list_max(draws)) - 1 AS INTEGER) AS grown_shard FROM raw JOIN summed USING (i))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM placed
"""


def oracle_sql() -> dict[str, str]:
    from tessera.llm.oracles import CHAT_SQL, TRIE_SQL, merkle_sql

    return {"op10_sharding": SHARDING_SQL, "op11_chat_formatting": CHAT_SQL, "op12_prefix_trie": TRIE_SQL, "op13_merkle_manifest": merkle_sql()}
