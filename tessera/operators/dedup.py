"""Exact and near duplicates of registered texts, scoped by columns; registration order decides who stays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.minhash import with_signatures
from tessera.sources.scratch import written

#: Permutations, words in a shingle, and similarity (fixed values).
PERMUTATIONS, SHINGLE, THRESHOLD = 128, 3, 0.9
#: Bands and their rows: a pair at the threshold is missed once in 8,000 times.
BANDS, ROWS = 16, 8


def signature(*parts: str | Column) -> Column:
    """sha256 of the parts joined by |; nulls as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, nulls last; found before the shuffle as far as it can be, so that a key of many rows is one row of each task."""
    rank = F.struct(*(c for o in order for c in (F.col(o).isNull(), F.col(o))))
    best = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), rank).alias("_row"))
    return best.select("_row.*")


def exact_dedup(df: DataFrame, parts: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_of(df.withColumn("signature", signature(*parts)), ["signature"], order)


def shingles(text: Column, k: int = SHINGLE, word: str = r"(?U)\w+", of: Callable[[Column], Column] = lambda s: s) -> Column:
    """`of` the distinct k-grams of lower-case words; fewer words give one shingle of all; no words give the trimmed text, or nothing. Equal values of `of` are one."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))

    def grams(w: Column) -> Column:
        # words are got one by one: a slice copies the whole array first
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: of(F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))))
        return F.when(F.size(w) >= k, F.array_distinct(runs)).when(F.size(w) > 0, F.array(of(F.array_join(w, " ")))).when(plain != "", F.array(of(plain))).otherwise(F.slice(F.array(of(plain)), 1, 0))

    # the words are bound to a variable, or each shingle would split the text anew
    return F.element_at(F.transform(F.array(F.regexp_extract_all(plain, F.lit(word), F.lit(0))), grams), 1)


def once(value: Column) -> Column:
    """The value as a row of its own, so that what filters by it or uses it twice does not work it out again."""
    return F.explode(F.array(value))


def shingled(df: DataFrame, text: str, k: int = SHINGLE, word: str = r"(?U)\w+") -> DataFrame:
    """Adds shingle_hashes; rows without shingles go."""
    return df.select("*", once(shingles(F.col(text), k, word, F.xxhash64)).alias("shingle_hashes")).where(F.size("shingle_hashes") > 0)


def signatures(rows: DataFrame, keys: Sequence[str], permutations: int = PERMUTATIONS) -> DataFrame:
    """keys and minhash of each row: the least of each permutation over its shingles."""
    signed = with_signatures(rows.select(*keys, *({"shingle_hashes"} - set(keys))), "shingle_hashes", permutations)
    return signed.select(*keys, "minhash")


def slots_agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    share = lambda both: both / (F.size(a) + F.size(b) - both)
    return F.element_at(F.transform(F.array(F.size(F.array_intersect(a, b))), share), 1)


def near_pairs(df: DataFrame, id_column: str, text: str, scope: Sequence[str] = (), threshold: float = THRESHOLD, word: str = r"(?U)\w+", verify: bool = True) -> DataFrame:
    """Pairs (a, b, similarity) of at least the threshold: exact Jaccard similarity, or with verify off the share of agreeing signature slots. Texts of equal shingles are linked to the least id among them; links between different texts are all of the candidates'."""
    # one column stands for the scope, so that nulls are equal
    one_scope = F.to_json(F.struct(F.lit(0).alias("_"), *scope), {"ignoreNullFields": "false"})
    sets = shingled(df, text, word=word).select(F.col(id_column).alias("id"), one_scope.alias("scope"), F.xxhash64(F.sort_array("shingle_hashes")).alias("class"), "shingle_hashes")
    value, measure = ("shingle_hashes", jaccard) if verify else ("minhash", slots_agreeing)
    key = F.array(*(F.xxhash64(F.slice("minhash", i * ROWS + 1, ROWS), F.lit(i), "scope") for i in range(BANDS)))
    # texts are read once; what follows reads short columns, and the sets of candidates alone
    signed = written(signatures(sets, sets.columns).select("id", "scope", "class", value, key.alias("bands")), "near-signed")
    least = signed.groupBy("scope", "class").agg(F.min("id").alias("rep"))
    known = signed.select("id", "scope", "class", "bands").join(least, ["scope", "class"])
    copies = known.where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    bands = known.where(F.col("id") == F.col("rep")).select("id", F.explode("bands").alias("band"))
    pairs = written(bands.withColumnRenamed("id", "a").join(bands.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b").distinct(), "near-pairs")
    met = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    of = signed.select("id", value).join(met, F.col("id") == F.col("_id"), "left_semi")
    one, two = (of.select(F.col("id").alias(x), F.col(value).alias(f"v{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", once(measure(F.col("va"), F.col("vb"))).alias("similarity"))
    return both.where(F.col("similarity") >= threshold).union(copies)


def semantic_text(topic: Column, question: Column, answer: Column, schema: Column, constraints: Column, payload: Column) -> Column:
    """The six lines that near-dedup reads; a payload stands in where all are empty."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), F.coalesce(c.cast("string"), F.lit(""))) for n, c in (("topic", topic), ("question", question), ("answer", answer), ("schema", schema), ("constraints", constraints), ("payload", payload))))
    empty = F.concat_ws("", topic, question, answer, schema, constraints) == ""
    return F.when(empty, F.coalesce(payload, F.lit(""))).otherwise(lines)
