"""Pass rates of tasks: exact intervals, decisions, early stops, divergence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.contracts import open_form


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def clopper_pearson(passes: int, n: int, alpha: float) -> tuple[float, float]:
    """The exact interval of a pass rate, by bisection on the binomial tails; [0, 1] without runs."""
    if n == 0:
        return 0.0, 1.0

    def solve(k: int, at: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _tail(k, n, mid) < at else (lo, mid)
        return (lo + hi) / 2

    return (0.0 if passes == 0 else solve(passes, alpha / 2)), (1.0 if passes == n else solve(passes + 1, 1 - alpha / 2))


def interval_table(spark: SparkSession, most: int = 30, alpha: float = 0.1) -> DataFrame:
    """(n, passes, ci_low, ci_high) of every outcome of up to `most` runs."""
    rows = [(n, k, *(round(x, 6) for x in clopper_pearson(k, n, alpha))) for n in range(most + 1) for k in range(n + 1)]
    return spark.createDataFrame(rows, "n int, passes int, ci_low double, ci_high double")


def pass_rates(runs: DataFrame, key: str, matched: Column, failed: Column) -> DataFrame:
    """key, n, passes, pass_rate; runs that failed for other reasons do not count, and a task without runs has rate 0."""
    ok = ~F.coalesce(failed, F.lit(False))
    out = runs.groupBy(key).agg(F.count_if(ok).alias("n"), F.count_if(ok & F.coalesce(matched, F.lit(False))).alias("passes"))
    return out.withColumn("pass_rate", F.when(F.col("n") > 0, F.col("passes") / F.col("n")).otherwise(0.0))


def possible(total: Column, n: Column, passes: Column, low: float, high: float) -> Column:
    """too_hard or too_easy if the final rate cannot get into the band any more, accept if it must end there, or else continue."""
    worst, best = passes / total, (passes + total - n) / total
    return F.when(best < low, "too_hard").when(worst > high, "too_easy").when((worst >= low) & (best <= high), "accept").otherwise("continue")


def decide(ci_low: Column, ci_high: Column, sure: Column, low: float, high: float) -> Column:
    """The sure decision if there is one, or else where the interval lies."""
    return F.when(sure != "continue", sure).when(ci_high < low, "too_hard").when(ci_low > high, "too_easy").when((ci_low >= low) & (ci_high <= high), "accept").otherwise("continue")


def gate(decision: Column, rate: Column, divergence: Column, low: float, high: float, most_divergence: float) -> Column:
    """The final verdict: an open decision falls to the point rate; answers that diverge too much are rejected."""
    settled = F.when(decision != "continue", decision).when(rate < low, "too_hard").when(rate > high, "too_easy").otherwise("accept")
    return F.when(divergence > most_divergence, "divergent").otherwise(settled)


def divergence(runs: DataFrame, key: str, answer: str) -> DataFrame:
    """key, submissions, answers, divergence: different answers, whatever their spelling, for each submission; empty ones left out."""
    each = runs.where(F.coalesce(answer, F.lit("")) != "").groupBy(key, open_form(F.col(answer)).alias("_form")).agg(F.count("*").alias("_n"))
    out = each.groupBy(key).agg(F.sum("_n").alias("submissions"), F.count("*").alias("answers"))
    return out.withColumn("divergence", F.col("answers") / F.col("submissions"))


def batched(runs: DataFrame, key: str, order: list[str], matched: Column, total: int, batch: int, low: float, high: float) -> DataFrame:
    """key, runs_used, passes, decision: runs are taken in batches, and no more after the first that decides."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = runs.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= total).withColumn("_p", F.sum(matched.cast("int")).over(w))
    last = Window.partitionBy(key)
    rows = rows.withColumn("_all", F.max("_i").over(last)).where((F.col("_i") % batch == 0) | (F.col("_i") == F.col("_all")))
    rows = rows.withColumn("decision", possible(F.lit(total), F.col("_i"), F.col("_p"), low, high))
    first = Window.partitionBy(key).orderBy(F.when(F.col("decision") != "continue", 0).otherwise(1), F.when(F.col("decision") != "continue", F.col("_i")).otherwise(-F.col("_i")))
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, F.col("_i").alias("runs_used"), F.col("_p").cast("bigint").alias("passes"), "decision")
