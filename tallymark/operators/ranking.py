"""Rank statistics with ties and missing scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running_sums


def tie_groups(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Per keys and distinct score (missing scores are one group below all): n, positives p and negatives q.

    The groups, not the rows, are what is put in order below.
    """
    return rows.groupBy(*keys, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(positive).alias("p")).withColumn("q", F.col("n") - F.col("p"))


def auroc(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUROC with average ranks; null if one class is missing."""
    g = running_sums(tie_groups(rows, keys, score, positive), keys, [F.col("s").asc_nulls_first()], ["q"])
    wins = g.withColumn("wins", F.col("p") * (F.col("upto_q") - F.col("q") / 2.0))
    sums = wins.groupBy(*keys).agg(F.sum("wins").alias("wins"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return sums.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg")))).drop("wins")


def curve(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Running true and false positives from the highest score down, a row per tie group."""
    g = running_sums(tie_groups(rows, keys, score, positive), keys, [F.col("s").desc_nulls_last()], ["p", "q"])
    return g.withColumnsRenamed({"upto_p": "tp", "upto_q": "fp"}).drop("q")


def auprc(rows: DataFrame, keys: list[str], score: str, positive: Column, totals: DataFrame) -> DataFrame:
    """Average precision by tie groups; recall counts all reference flags (``totals``: keys, n_gt), retrieved or not."""
    c = curve(rows, keys, score, positive).join(totals, keys)
    part = F.when(F.col("n_gt") > 0, F.col("p") / F.col("n_gt") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return c.withColumn("part", part).groupBy(*keys).agg(F.sum("part").alias("auprc"))


def recall_at_fp(rows: DataFrame, keys: list[str], score: str, positive: Column, totals: DataFrame, budgets: list[int]) -> DataFrame:
    """Recall of the last tie group whose false positives fit the budget, else 0; null without a reference flag."""
    c = curve(rows, keys, score, positive).join(totals, keys)
    recall = F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt"))
    some = F.max("n_gt") > 0
    return c.groupBy(*keys).agg(*[F.when(some, F.coalesce(F.max(F.when(F.col("fp") <= b, recall)), F.lit(0.0))).alias(f"recall_at_{b}_fp") for b in budgets])


def average_precision(rows: DataFrame, keys: list[str], score: str, positive: Column, tiebreak: str) -> DataFrame:
    """Average precision over single rows in a stable order; the denominator is the positives in the list."""
    single = rows.select(*keys, F.col(score).alias("s"), F.col(tiebreak).alias("t"), F.lit(1).alias("n"), F.coalesce(positive.cast("int"), F.lit(0)).alias("p"))
    ranked = running_sums(single, keys, [F.col("s").desc_nulls_last(), F.col("t").asc()], ["n", "p"])
    hit = F.when(F.col("p") == 1, F.col("upto_p") / F.col("upto_n"))
    return ranked.groupBy(*keys).agg((F.sum(hit) / F.sum("p")).alias("average_precision"))


def top_k(rows: DataFrame, keys: list[str], by: str, k: int, *tiebreak: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *tiebreak)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
