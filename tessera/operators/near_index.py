"""A kept index of texts in which near duplicates are looked up, scope by scope, as new texts come.

Three Parquet tables in one folder: `entries` names one text of each shingle set, the first that came; `sets` has its
set, a bitmap of it, and the keys of its signature's bands; `bands` has a row for each key. `entries` and `bands` are laid out by buckets
(of the set, and of the key), so that a batch reads the buckets that it touches, and all by batch, so that a batch that
comes again replaces itself. Sets, which are larger than the texts, are written once, where they are made, and never
shuffled but for those of candidates; a text is shingled twice for that: to be named, and, if it is a set's first, to be
kept. Equal sets are never compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.minhash import most_common, with_signatures
from tessera.operators import dedup
from tessera.sources.scratch import discard, exists, shuffles_dropped, written

#: Parts of a table by hash; a batch reads those that its rows fall into.
BUCKETS = 64
#: Numbers that are sent to all executors at most: of copies in a batch (beyond it, its texts are shuffled), and of marks that candidates have (one may share its mark with others, whose sets are then shuffled too).
FEW = 2**21


def scope_of(scope: Sequence[str]) -> Column:
    """One column for the scope, so that nulls are equal."""
    return F.to_json(F.struct(F.lit(0).alias("_"), *scope), {"ignoreNullFields": "false"})


class NearIndex:
    """Texts are compared within their scope only; threshold and signatures as in tessera.operators.dedup."""

    def __init__(self, spark: SparkSession, path: str, id_type: str, threshold: float = dedup.THRESHOLD, buckets: int = BUCKETS, word: str = r"(?U)\w+"):
        self.spark, self.path, self.threshold, self.buckets, self.word = spark, path.rstrip("/"), threshold, buckets, word
        self.entry_schema = f"id {id_type}, seq bigint, scope string, set1 bigint, set2 bigint, batch bigint, bucket int"
        self.set_schema = f"id {id_type}, seq bigint, scope string, size int, bits array<bigint>, shingle_hashes array<bigint>, bands array<bigint>, batch bigint"
        self.band_schema = "seq bigint, band bigint, batch bigint, bucket int"

    def _bucket(self, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, name: str, schema: str, batches: Column, touched: DataFrame | None = None) -> DataFrame:
        """A table, of the buckets that `touched` has rows in (at most `buckets` numbers)."""
        path = f"{self.path}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.schema(schema).parquet(path).where(batches)
        return table if touched is None else table.where(F.col("bucket").isin([r[0] for r in touched.select("bucket").distinct().collect()]))

    def _keep(self, rows: DataFrame, name: str, batch: int) -> None:
        with shuffles_dropped(self.spark):
            rows.withColumn("batch", F.lit(batch).cast("bigint")).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{self.path}/{name}")

    def entries(self) -> DataFrame:
        return self._read("entries", self.entry_schema, F.lit(True))

    def _told(self, texts: DataFrame, batch: int) -> DataFrame:
        """id, seq, scope, bucket and two hashes that stand for the shingle set of each text that has one; the first text of the set (rep), and whether it is the text itself."""
        ordered = F.sort_array("shingle_hashes")
        named = dedup.shingled(texts, "text", word=self.word).select("id", "seq", "scope", F.xxhash64(F.lit(1), ordered).alias("set1"), F.xxhash64(F.lit(2), ordered).alias("set2"))
        named = written(named.withColumn("bucket", self._bucket("scope", "set1", "set2")), "near-named")
        same = ["bucket", "scope", "set1", "set2"]
        known = self._read("entries", self.entry_schema, F.col("batch") < batch, named).select(*(F.col(c).alias(f"_{c}") for c in same), F.col("id").alias("first"))
        # the first text of each set: in the index, or in the batch
        own = named.groupBy(*same).agg(F.min(F.struct("seq", "id")).alias("own"))
        joined = own.join(known, [F.col(c) == F.col(f"_{c}") for c in same], "left")
        firsts = joined.select(*(F.col(c).alias(f"_{c}") for c in same), F.coalesce("first", "own.id").alias("rep"), F.col("first").isNull().alias("fresh"))
        told = named.join(firsts, [F.col(c) == F.col(f"_{c}") for c in same])
        told = written(told.select("id", "seq", *same, "rep", (F.col("fresh") & F.col("id").eqNullSafe(F.col("rep"))).alias("is_first")), "near-told")
        discard(self.spark, named.written_path)
        return told

    def add(self, rows: DataFrame, batch: int, key: str, seq: str, text: str, scope: Sequence[str] = (), verify: bool = True) -> DataFrame:
        """Looks up every row among the texts of smaller seq, in the index and in the batch, and adds the batch.

        Returns id, match, similarity for each row: the most similar earlier text of the scope, the earliest of equal
        ones, or null if none reaches the threshold. Similarity is exact, or with verify off the share of agreeing
        signature slots. A row without shingles matches nothing. The same batch number again gives the same result and
        the same index; batches come in the order of their seq. Neither id nor seq repeats or is null.
        """
        texts = rows.select(F.col(key).alias("id"), F.col(seq).cast("bigint").alias("seq"), scope_of(scope).alias("scope"), F.col(text).alias("text"))
        told = self._told(texts, batch)
        copies = told.where("not is_first").select(F.col("seq").alias("_seq"))
        new = texts.join(F.broadcast(copies) if copies.count() <= FEW else copies, F.col("seq") == F.col("_seq"), "left_anti")
        sets = with_signatures(dedup.shingled(new, "text", word=self.word).select("id", "seq", "scope", "shingle_hashes"), "shingle_hashes", dedup.PERMUTATIONS, mapped=True)
        bands = F.array(*(F.xxhash64(F.slice("minhash", i * dedup.ROWS + 1, dedup.ROWS), F.lit(i), "scope") for i in range(dedup.BANDS)))
        # into the batch's own folder: by columns, each task would sort its sets first
        with shuffles_dropped(self.spark):
            sets.select("id", "seq", "scope", F.size("shingle_hashes").alias("size"), "bits", "shingle_hashes", bands.alias("bands")).write.mode("overwrite").parquet(f"{self.path}/sets/batch={batch}")
        self._keep(told.where("is_first").select("id", "seq", "scope", "set1", "set2", "bucket"), "entries", batch)
        entered = self._read("sets", self.set_schema, F.col("batch") == batch)
        self._keep(entered.select("seq", F.explode("bands").alias("band")).withColumn("bucket", self._bucket("band")), "bands", batch)
        pairs = self._pairs(batch, verify)
        best = self._best(pairs, batch, verify).withColumnRenamed("seq", "_seq")
        # a text whose set came before matches that set's first; the first of a new set has what was found for it
        found = told.join(best, F.col("seq") == F.col("_seq"), "left").select(F.col("id").alias("_id"), F.when(F.col("is_first"), F.col("found.match")).otherwise(F.col("rep")).alias("match"), F.when(F.col("is_first"), F.col("found.similarity")).otherwise(1.0).alias("similarity"))
        said = written(found.where("match is not null"), "near-said")
        discard(self.spark, told.written_path, pairs.written_path)
        return rows.select(F.col(key).alias("id")).join(said, F.col("id") == F.col("_id"), "left").select("id", "match", "similarity")

    def _met(self, pairs: DataFrame, column: str, batches: Column) -> DataFrame:
        """Rows of `sets` that a pair may name in the column; those in no pair go before those in one are met."""
        mark = lambda c: F.pmod(F.xxhash64(c), F.lit(FEW))
        marks = pairs.select(mark(column).alias("_mark")).distinct()
        return self._read("sets", self.set_schema, batches).join(F.broadcast(marks), mark("seq") == F.col("_mark"), "left_semi")

    def _pairs(self, batch: int, verify: bool) -> DataFrame:
        """seq and other: a new text and an earlier one with which it shares a key. Where sets are to be compared, pairs that cannot reach the threshold by the sets' bitmaps, a small part of them, go before."""
        probes = self._read("bands", self.band_schema, F.col("batch") == batch)
        kept = self._read("bands", self.band_schema, F.col("batch") <= batch, probes)
        both = probes.alias("p").join(kept.alias("k"), F.expr("p.band = k.band and k.seq < p.seq"))
        pairs = written(both.select("p.seq", F.col("k.seq").alias("other")).distinct(), "near-pairs")
        if not verify:
            return pairs
        one, two = (self._met(pairs, c, batches).select(F.col("seq").alias(f"_{x}"), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits")) for x, c, batches in (("a", "seq", F.col("batch") == batch), ("b", "other", F.col("batch") <= batch)))
        most = most_common(F.col("a_bits"), F.col("b_bits"), F.col("a_size"), F.col("b_size"))
        # common / (sizes - common) reaches the threshold; a little less, for rounding
        reach = most * (1 + self.threshold) >= (F.col("a_size") + F.col("b_size")) * self.threshold - 1e-6
        near = written(pairs.join(one, F.col("seq") == F.col("_a")).join(two, F.col("other") == F.col("_b")).where(reach).select("seq", "other"), "near-reach")
        discard(self.spark, pairs.written_path)
        return near

    def _best(self, pairs: DataFrame, batch: int, verify: bool) -> DataFrame:
        """seq and found (match, similarity) of new texts."""
        value, measure = ("shingle_hashes", dedup.jaccard) if verify else ("minhash", dedup.slots_agreeing)

        def met(column: str, batches: Column) -> DataFrame:
            sets = self._met(pairs, column, batches).select("id", "seq", "scope", "shingle_hashes")
            return sets if verify else dedup.signatures(sets, ["id", "seq", "scope"])

        one = met("seq", F.col("batch") == batch).select(F.col("seq").alias("_seq"), F.col("scope").alias("_scope"), F.col(value).alias("own"))
        others = met("other", F.col("batch") <= batch).select(F.col("id").alias("match"), F.col("seq").alias("match_seq"), "scope", F.col(value).alias("theirs"))
        # keys are hashes of scopes too, but a scope is told by itself
        both = pairs.join(one, F.col("seq") == F.col("_seq")).join(others, F.expr("other = match_seq and scope = _scope"))
        scored = both.select("seq", "match", "match_seq", dedup.once(measure(F.col("own"), F.col("theirs"))).alias("similarity")).where(F.col("similarity") >= self.threshold)
        # the greatest similarity, then the earliest
        best = F.min_by(F.struct("match", "similarity"), F.struct(-F.col("similarity"), F.col("match_seq"), F.col("match")))
        return scored.groupBy("seq").agg(best.alias("found"))


def decide(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """rows with kept: one by one, a row is kept if no kept row before it is paired with it. pairs: a, b (ids, a before b).

    Each round decides rows that no undecided row before them is paired with, and those paired with a kept one; as many
    rounds as the longest chain of pairs is long. Rows without pairs are kept at once.
    """
    links = written(pairs.select("a", "b").distinct(), "near-links")
    state = written(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "near-state")
    while not state.where("kept is null").isEmpty():
        before = links.join(state.select(F.col("id").alias("a"), F.coalesce(F.col("kept").cast("string"), F.lit("open")).alias("was")), "a")
        facts = before.groupBy(F.col("b").alias("_b")).agg(F.bool_or(F.col("was") == "true").alias("beaten"), F.bool_or(F.col("was") == "open").alias("waits"))
        told = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = written(state.join(facts, F.col("id") == F.col("_b"), "left").select("id", told.alias("kept")), "near-state")
    return rows.join(state.select(F.col("id").alias("_id"), F.col("kept").alias("_kept")), F.col(key) == F.col("_id"), "left").withColumn("kept", F.coalesce("_kept", F.lit(True))).drop("_id", "_kept")
