"""Evaluation tables derived deterministically from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import mutual_pairs, near_pairs
from .staging import made_from, shared_folder

CATEGORIES = ["PlatformMove", "SuspiciousActivity", "Explicit-Flirting"]
RUNS = ["m1", "m2", "m3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: file, language, category, second, confidences, entropy."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "concat('call_', user_id) as file_id",
        "case user_id % 5 when 0 then 'hindi' when 1 then 'tamil' when 2 then 'telugu' when 3 then 'kannada' else 'malayalam' end as language",
        "case event_type when 'click' then 'PlatformMove' when 'purchase' then 'SuspiciousActivity' when 'view' then 'Explicit-Flirting' when 'error' then 'PlatformMove' else 'Not a violation' end as category",
        "cast(floor(((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 4320.0D) as int) as t_sec",
        "case when event_id % 10 = 9 then null else cast(get_json_object(props, '$.k') as double) / 100.0D end as confidence",
        "case when event_id % 17 = 0 then null else (event_id % 101) / 101.0D end as logprob_confidence",
        "case when event_id % 19 = 0 then null else (event_id % 41) / 10.0D end as entropy_mean",
        "value", "ts",
    )


def gt_flags(b: DataFrame) -> DataFrame:
    return b.where("event_id % 8 = 0 and user_id % 2 = 0 and category <> 'Not a violation'")


def model_flags(b: DataFrame) -> DataFrame:
    """Flags of three runs, paired one to one with the reference flags of their file.

    A flag and a reference flag within 60 s are a pair if each is the other's best: own
    category first, then the nearest, then the lower id. So a flag may catch a reference
    flag of another category.
    """
    flags = b.where("event_id % 8 in (1, 2, 3)").selectExpr(
        "*", "concat('m', event_id % 8) as run_key",
        "case event_id % 8 when 1 then 'v3' when 2 then 'v4' else 'v6' end as prompt",
        "case event_id % 7 when 0 then 'reported' when 1 then 'denial' when 2 then 'hypothetical' when 3 then null else 'direct' end as speech_act",
        "case when event_id % 11 = 0 then 'no' when event_id % 11 = 1 then null else 'yes' end as violation",
        "case event_id % 13 when 0 then 'unclear' when 1 then 'user' else 'expert' end as speaker",
        "case event_id % 9 when 0 then 'DUPLICATE_OR_EXTRA_INSTANCE' when 1 then 'GT_MISS' when 2 then 'MATCHER_MISS' when 3 then 'UNCLEAR' when 4 then 'HALLUCINATED_QUOTE' else null end as fp_mark",
    )
    pairs = near_pairs(gt_flags(b), flags, 60).withColumn("other", (F.col("gc") != F.col("mc")).cast("int"))
    hits = mutual_pairs(pairs, ["other", "delta"]).select(F.col("mi").alias("event_id"), F.col("gi").alias("matched_gi"), F.col("gc").alias("matched_gt_category"))
    marked = flags.join(hits, "event_id", "left").withColumn("matched", F.col("matched_gi").isNotNull())
    return marked.withColumn("fp_type", F.when(~F.col("matched"), F.col("fp_mark")))


def files(b: DataFrame) -> DataFrame:
    """Every (run, file), also those without any flag."""
    runs = F.explode(F.array(*map(F.lit, RUNS)))
    return b.select("file_id", "language", "user_id").distinct().select(runs.alias("run_key"), "file_id", "language", "user_id")


def segments(b: DataFrame) -> DataFrame:
    return b.select("file_id", "user_id").distinct().selectExpr("file_id", "60 + user_id * 7 % 541 as duration_s", "case when user_id % 23 = 0 then null else user_id * 13 % 97 end as snr_db")


_staged: set[str] = set()


def staged_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, reference flags and model flags, derived once for an application and read from the shared folder."""
    root = f"{shared_folder(spark)}/{made_from(spark, f'{sf_dir}/events.parquet')}/fx"
    made = {"files": lambda: files(base(spark, sf_dir)), "gt": lambda: gt_flags(base(spark, sf_dir)), "flags": lambda: model_flags(base(spark, sf_dir))}
    if root not in _staged:
        for name, make in made.items():
            make().write.mode("overwrite").parquet(f"{root}/{name}")
        _staged.add(root)
    return tuple(spark.read.parquet(f"{root}/{name}") for name in made)
