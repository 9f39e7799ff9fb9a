"""The fixed development set (L5): usable files, choice by quotas, checks and manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import samples as Q
from ..operators.scoring import CATEGORIES
from ..sources import documents as R
from ..sources import fixtures as X
from ..sources import io
from .base import query
from .confusion_queries import tables
from .document_queries import GT_OK, gt_docs, result_docs
from .versioned_queries import new_folder

P90 = "p as (select quantile_cont(duration_s, 0.9) as p90 from fx_segments)"


def usable(spark, d):
    """Files with a whole reference of a complete transcript and a result of every run, up to the 90th percentile of duration."""
    seg = X.segments(X.base(spark, d))
    p90 = seg.agg(F.percentile("duration_s", 0.9).alias("p90"))
    whole = R.successful_gt(gt_docs(spark, d)).where("not transcript.incomplete_transcript").select("file_id")
    runs = tables(spark, d)[0].select("run_key").distinct().agg(F.count("*").alias("n_runs"))
    got = result_docs(spark, d).where("status = 'success'").groupBy("file_id").agg(F.count_distinct("run_key").alias("n"))
    complete = got.crossJoin(F.broadcast(runs)).where("n = n_runs").select("file_id")
    return seg.crossJoin(F.broadcast(p90)).where("duration_s <= p90").select("file_id", "duration_s").join(whole, "file_id", "left_semi").join(complete, "file_id", "left_semi")


@query("l5_usable_files", f"with {P90}, u as (select distinct file_id, user_id from fx_base) select file_id, duration_s from u join fx_segments using (file_id), p where duration_s <= p90 and {GT_OK} and user_id % 9 <> 1 and user_id % 7 <> 2", fx=True)
def l5_usable_files(spark, d):
    return usable(spark, d)


def dev_files(spark, d):
    """Signals of every usable file: reference flags by category, and how many of the runs flag it and get it right."""
    files, gt, flags = tables(spark, d)
    g = gt.groupBy("file_id").agg(F.count("*").alias("gt_flag_count"), F.collect_set("category").alias("gt_categories"))
    raised = flags.select("run_key", "file_id").distinct().withColumn("flagged", F.lit(1))
    n = files.join(raised, ["run_key", "file_id"], "left").groupBy("file_id", "language").agg(F.count("*").alias("n_runs"), F.count("flagged").alias("n_flagged"))
    kept = n.join(usable(spark, d), "file_id").join(g, "file_id", "left")
    kept = kept.withColumns({"gt_flag_count": F.coalesce("gt_flag_count", F.lit(0)), "positive": F.col("gt_categories").isNotNull()})
    return kept.withColumn("n_correct", F.when(F.col("positive"), F.col("n_flagged")).otherwise(F.col("n_runs") - F.col("n_flagged")))


MANIFEST = ["language", "file_id", "slot", "place", "substituted", "reason", "gt_flag_count", "gt_categories", "n_runs", "n_flagged", "n_correct", "duration_s"]


def dev_set(spark, d):
    has = lambda c: F.array_contains("gt_categories", c)
    few, most = F.col("n_correct") * 8 <= F.col("n_runs") * 3, F.col("n_flagged") * 8 >= F.col("n_runs") * 3
    slots = [Q.Slot(f"positive: {c}", 1, True, has(c)) for c in CATEGORIES] + [
        Q.Slot("positive: hard miss", 2, True, few), Q.Slot("negative: hard clean", 3, False, most), Q.Slot("negative: easy clean", 2, False, F.col("n_flagged") * 8 <= F.col("n_runs")),
    ]
    # most disagreement first, then by a seeded digest
    order = [F.abs(2 * F.col("n_correct") - F.col("n_runs")), F.md5(F.concat(F.lit("42|"), "file_id")), F.col("file_id")]
    return Q.by_quota(dev_files(spark, d), "language", "file_id", F.col("positive"), slots, order)


@query("l5_dev_set_filled")
def l5_dev_set_filled(spark, d):
    """Five positive and five negative files a language by slots; a slot without candidates is filled from the nearest one, with the reason."""
    return dev_set(spark, d)


@query("l5_dev_set_checks")
def l5_dev_set_checks(spark, d):
    """Whether the chosen set holds five positives of each category, 30 reference flags and ten files with more than one."""
    chosen = dev_set(spark, d).join(dev_files(spark, d).drop("language"), "file_id")
    has = lambda c: F.count_if(F.array_contains("gt_categories", c))
    n = chosen.agg(*[has(c).alias(c) for c in CATEGORIES], F.sum("gt_flag_count").alias("flags"), F.count_if(F.col("gt_flag_count") > 1).alias("multi"))
    check = lambda name, c, least: F.struct(F.lit(name).alias("condition"), F.col(c).cast("long").alias("n"), (F.col(c) >= least).alias("holds"))
    return n.select(F.inline(F.array(*[check(f"files with {c}", c, 5) for c in CATEGORIES], check("reference flags", "flags", 30), check("files with several", "multi", 10))))


@query("l5_dev_manifest")
def l5_dev_manifest(spark, d):
    """The manifest of the set as it is written and read back: signals, slot and reason of every chosen file."""
    path = f"{new_folder(spark, 'dev')}/dev_set_v1"
    rows = dev_set(spark, d).join(dev_files(spark, d).drop("language"), "file_id").withColumn("gt_categories", F.array_join(F.array_sort("gt_categories"), ";"))
    io.write_once(rows.select(*MANIFEST), path)
    return spark.read.option("header", "true").csv(path)
