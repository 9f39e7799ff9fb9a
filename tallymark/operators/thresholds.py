"""Threshold sweeps.

Each flag is reduced to the number of grid thresholds it reaches, each file to the
largest such number per category, and only the resulting small histograms meet the
grid. The flags are read once, whatever the size of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confusion import category_rows, metrics, ratio
from .scoring import CATEGORIES, redundant

TENTHS = [i / 10 for i in range(10)]
ENTROPY = [-4.0, -2.0, -1.0, -0.5, -0.25, -0.1, -0.05, -0.02, -0.01, 0.0]
ALL_CATEGORIES = [*CATEGORIES, "ALL"]


def level_of(score: Column, grid: list[float]) -> Column:
    """How many thresholds of an ascending grid a score reaches; a missing score reaches none."""
    reached = sum(((score >= t).cast("int") for t in grid), F.lit(0))
    return F.coalesce(reached, F.lit(0))


def sweep(files: DataFrame, gt: DataFrame, flags: DataFrame, score: str, grid: list[float], keys: tuple[str, ...] = ("run_key", "language"), all_keys: tuple[str, ...] = ("language",)) -> DataFrame:
    """One row per keys, category and threshold (null threshold: every flag counts).

    ``files``: run_key, file_id and the keys; ``gt``: file_id, category; ``flags``: run_key, file_id, category,
    matched, matched_gt_category, fp_type and the score. Keys in ``all_keys`` also get an ALL row.
    """
    spark = files.sparkSession
    file_key = ["run_key", "file_id"]
    flags = flags.select(*file_key, "category", "matched", "matched_gt_category", redundant().alias("redundant"), F.col(score).isNull().alias("missing"), level_of(F.col(score), grid).alias("level"))
    own = category_rows(flags, "category", "cat")
    strict = category_rows(flags.where("matched"), "matched_gt_category", "cat")
    none = F.lit(None).cast("int")
    reached = own.select(*file_key, "cat", F.col("level").alias("loose"), none.alias("strict")).unionByName(strict.select(*file_key, "cat", none.alias("loose"), F.col("level").alias("strict")))
    reached = reached.groupBy(*file_key, "cat").agg(F.max("loose").alias("loose"), F.max("strict").alias("strict"))
    gt_files = category_rows(gt, "category", "cat").groupBy("file_id", "cat").agg(F.count("*").alias("n_gt"))

    cats = F.explode(F.array(*map(F.lit, ALL_CATEGORIES))).alias("cat")
    grid_files = files.select("file_id", *{"run_key": 1, **dict.fromkeys(keys)}, cats)
    state = grid_files.join(reached, [*file_key, "cat"], "left").join(gt_files, ["file_id", "cat"], "left")
    state = state.withColumns({"loose": F.coalesce("loose", F.lit(-1)), "strict": F.coalesce("strict", F.lit(-1)), "n_gt": F.coalesce("n_gt", F.lit(0))})
    file_hist = state.groupBy(*keys, "cat", "loose", "strict", (F.col("n_gt") > 0).alias("positive")).agg(F.count("*").alias("n"), F.sum("n_gt").alias("n_gt"))
    flag_keys = [k for k in keys if k not in flags.columns]
    placed = own.join(files.select(*file_key, *flag_keys), file_key) if flag_keys else own
    flag_hist = placed.groupBy(*keys, "cat", "level", "matched", "redundant", "missing").agg(F.count("*").alias("n"))
    for k in all_keys:
        file_hist = file_hist.withColumn(k, F.explode(F.array(F.col(k), F.lit("ALL"))))
        flag_hist = flag_hist.withColumn(k, F.explode(F.array(F.col(k), F.lit("ALL"))))

    steps = spark.createDataFrame([(0, None), *((i + 1, t) for i, t in enumerate(grid))], "step int, threshold double")
    at_files = file_hist.crossJoin(F.broadcast(steps)).groupBy(*keys, "cat", "threshold")
    add = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    pos, strict_on, loose_on = F.col("positive"), F.col("strict") >= F.col("step"), F.col("loose") >= F.col("step")
    counted = at_files.agg(
        add(pos).alias("n_gt_pos"), add(~pos).alias("n_gt_neg"), add(pos & strict_on).alias("tp"), add(~pos & loose_on).alias("fp"),
        add(pos & ~strict_on).alias("fn"), add(~pos & ~loose_on).alias("tn"), add(pos & loose_on).alias("loose_tp"), F.sum("n_gt").alias("total_gt"),
    )
    on = F.col("level") >= F.col("step")
    flagged = flag_hist.crossJoin(F.broadcast(steps)).groupBy(*keys, "cat", "threshold").agg(
        add(on & F.col("matched")).alias("flag_tp"), add(on & ~F.col("matched") & ~F.col("redundant")).alias("flag_fp"),
        add(on & F.col("redundant")).alias("flag_redundant"), add(F.col("missing")).alias("n_missing"),
    )
    same = [counted[k].eqNullSafe(flagged[k]) for k in (*keys, "cat", "threshold")]
    both = counted.join(flagged, same, "left").select(*[counted[c] for c in counted.columns], *[F.coalesce(flagged[c], F.lit(0)).alias(c) for c in ("flag_tp", "flag_fp", "flag_redundant", "n_missing")])
    out = metrics(both).withColumn("flag_fn", F.col("total_gt") - F.col("flag_tp"))
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    good = F.col("flag_tp") + F.col("flag_redundant")
    return out.withColumns({
        "f1": f1, "loose_recall": ratio(F.col("loose_tp"), F.col("n_gt_pos")),
        "flag_precision": ratio(good, good + F.col("flag_fp")), "flag_recall": ratio(F.col("flag_tp"), F.col("flag_tp") + F.col("flag_fn")),
    }).withColumnRenamed("cat", "category")


SWEEP_COUNTS = ["n_gt_pos", "n_gt_neg", "tp", "fp", "fn", "tn", "loose_tp", "flag_tp", "flag_fp", "flag_redundant", "flag_fn", "n_missing"]
SWEEP_RATIOS = ["precision", "recall", "specificity", "accuracy", "f1", "loose_recall", "flag_precision", "flag_recall"]


def rises(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a sweep that break monotonicity: TP or FP above, or TN below, that of the threshold before."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(F.col("threshold").asc_nulls_first())
    before = lambda c: F.lag(c).over(w)
    marked = table.withColumn("bad", (F.col("tp") > before("tp")) | (F.col("fp") > before("fp")) | (F.col("tn") < before("tn")))
    return marked.where("bad").drop("bad")
