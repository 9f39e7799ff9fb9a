"""Confusion counts at file and flag level, buckets and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import CATEGORIES, redundant


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or missing."""
    return F.when(b != 0, a.cast("double") / b)


def metrics(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> DataFrame:
    """precision, recall, specificity and accuracy of a confusion row."""
    t, f, m, n = map(F.col, (tp, fp, fn, tn))
    return df.withColumns({"precision": ratio(t, t + f), "recall": ratio(t, t + m), "specificity": ratio(n, n + f), "accuracy": ratio(t + n, t + f + m + n)})


def per_file(files: DataFrame, gt: DataFrame, flags: DataFrame) -> DataFrame:
    """Counts and bucket of every (run, file); files without flags are rows too.

    ``flag_fn`` is reference flags less matched flags; the pairing is one to one, so it is not below 0.
    """
    g = gt.groupBy("file_id").agg(F.count("*").alias("n_gt"))
    m = flags.groupBy("run_key", "file_id").agg(F.count("*").alias("n_flags"), F.count_if("matched").alias("flag_tp"), F.count_if(redundant()).alias("flag_redundant"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = files.join(g, "file_id", "left").join(m, ["run_key", "file_id"], "left").withColumns({c: zero(F.col(c)) for c in ("n_gt", "n_flags", "flag_tp", "flag_redundant")})
    bucket = F.when((F.col("n_gt") > 0) & (F.col("flag_tp") > 0), "TP").when(F.col("n_gt") > 0, "FN").when(F.col("n_flags") > 0, "FP").otherwise("TN")
    return joined.withColumns({"flag_fp": F.col("n_flags") - F.col("flag_tp"), "flag_fn": F.col("n_gt") - F.col("flag_tp"), "file_bucket": bucket})


def with_all(df: DataFrame, column: str) -> DataFrame:
    """Each row under its own value and under ALL."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit("ALL"))))


def file_level(scored: DataFrame, *keys: str) -> DataFrame:
    counts = scored.groupBy(*keys).agg(*[F.count_if(F.col("file_bucket") == b.upper()).alias(b) for b in ("tp", "fp", "fn", "tn")])
    return metrics(counts)


def flag_level(scored: DataFrame, *keys: str) -> DataFrame:
    """Flag-level confusion; redundant flags are no errors, and TN counts files without flags on either side."""
    sums = scored.groupBy(*keys).agg(
        F.sum("flag_tp").alias("tp"), (F.sum("flag_fp") - F.sum("flag_redundant")).alias("fp"), F.sum("flag_fn").alias("fn"),
        F.count_if((F.col("n_gt") == 0) & (F.col("n_flags") == 0)).alias("tn"), F.sum("flag_redundant").alias("redundant"),
    )
    good = F.col("tp") + F.col("redundant")
    return metrics(sums).withColumn("precision", ratio(good, good + F.col("fp")))


def qualifying_bucket(scored: DataFrame, gt: DataFrame, matched_gt: DataFrame, least: float = 0.8) -> DataFrame:
    """TP where all confident reference flags of two categories are matched (and there is one), else the file's bucket."""
    wanted = gt.where(F.col("category").isin("PlatformMove", "Explicit-Flirting") & (F.coalesce("confidence", F.lit(0.0)) >= least)).select("file_id", "gt_index")
    runs = scored.select("run_key", "file_id", "file_bucket")
    hit = matched_gt.select("run_key", "file_id", "gt_index").distinct().withColumn("hit", F.lit(1))
    state = runs.join(wanted, "file_id", "left").join(hit, ["run_key", "file_id", "gt_index"], "left").groupBy("run_key", "file_id", "file_bucket").agg(F.count("gt_index").alias("n_wanted"), F.count("hit").alias("n_hit"))
    full = (F.col("n_wanted") > 0) & (F.col("n_wanted") == F.col("n_hit"))
    return state.withColumn("qualifying_bucket", F.when(full, "TP").otherwise(F.col("file_bucket")))


def five_bins(spark) -> DataFrame:
    edges = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0001)]
    return spark.createDataFrame([(f"{lo:.1f}-{min(hi, 1.0):.1f}", lo, hi) for lo, hi in edges], "bucket string, lo double, hi double")


def bin_table(flags: DataFrame, bins: DataFrame, confidence: str) -> DataFrame:
    """Per run and confidence bin: flags, TP, FP, precision and entropy means; every bin is present."""
    c = F.col(confidence)
    found = flags.where(c.isNotNull()).join(F.broadcast(bins), (c >= F.col("lo")) & (c < F.col("hi")))
    stats = found.groupBy("run_key", "bucket").agg(
        F.count("*").alias("n_flags"), F.count_if("matched").alias("tp"), F.avg("entropy_mean").alias("mean_entropy"),
        F.avg(F.when(F.col("matched"), F.col("entropy_mean"))).alias("mean_entropy_tp"), F.avg(F.when(~F.col("matched"), F.col("entropy_mean"))).alias("mean_entropy_fp"),
    )
    grid = flags.select("run_key").distinct().crossJoin(F.broadcast(bins.select("bucket")))
    out = grid.join(stats, ["run_key", "bucket"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_flags", "tp")})
    return out.withColumn("fp", F.col("n_flags") - F.col("tp")).withColumn("precision", ratio(F.col("tp"), F.col("n_flags")))


def decile_of(score: Column) -> Column:
    """'0.3-0.4' and so on; 1.0 is in the last one; missing and out_of_range otherwise."""
    out = F.when(score.isNull(), "missing")
    for i in range(10):
        lo, hi = i / 10, (i + 1) / 10
        inside = (score >= lo) & ((score <= hi) if i == 9 else (score < hi))
        out = out.when(inside, f"{lo:.1f}-{hi:.1f}")
    return out.otherwise("out_of_range")


DECILES = [f"{i / 10:.1f}-{(i + 1) / 10:.1f}" for i in range(10)]


def category_rows(df: DataFrame, column: str = "category", name: str = "category") -> DataFrame:
    """Rows under their own category, if it is a real one, and under ALL."""
    own = F.when(F.col(column).isin(*CATEGORIES), F.array(F.col(column), F.lit("ALL"))).otherwise(F.array(F.lit("ALL")))
    return df.withColumn(name, F.explode(own))
