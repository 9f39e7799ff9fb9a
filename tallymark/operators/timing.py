"""Log sessions, spans and real-time factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running_sums


def sessions(lines: DataFrame, key: str, load: Column) -> DataFrame:
    """Calls of a log: lines between loads, each lasting until the next line.

    ``lines``: key, event_id, sec. A load starts a new run and discards the call that is
    open; lines before the first load belong to no run.
    """
    w = W.partitionBy(key).orderBy("sec", "event_id")
    marked = lines.withColumn("_load", load).withColumns({
        "run_no": F.sum(F.col("_load").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "_next": F.lead("sec").over(w), "_next_load": F.lead("_load").over(w),
    })
    open_ = ~F.col("_load") & (F.col("run_no") > 0) & F.col("_next").isNotNull() & ~F.col("_next_load") & (F.col("_next") > F.col("sec"))
    return marked.where(open_).withColumn("seconds", F.col("_next") - F.col("sec")).drop("_load", "_next", "_next_load")


def without_outliers(calls: DataFrame, key: str, value: str) -> DataFrame:
    """Calls up to Q3 + 3 (Q3 - Q1), quartiles by index; groups under four calls are kept whole.

    The quartiles come from counts of distinct values, so that no group is gathered in one row.
    """
    by_value = calls.groupBy(F.col(key).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    run = running_sums(by_value, ["_g"], [F.col("_v").asc()], ["_k"])
    total = calls.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("n"))
    at = lambda i: F.min(F.when(F.col("upto__k") > F.floor(i), F.col("_v")))
    q = run.join(total, F.col("_g").eqNullSafe(F.col("_of"))).groupBy(F.col("_g").alias(key), "n").agg(at(F.col("n") / 4).alias("q1"), at(F.col("n") * 3 / 4).alias("q3"))
    cut = q.select(F.col(key).alias("_key"), "n", F.when(F.col("n") >= 4, F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).alias("cut"))
    return calls.join(cut, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("cut").isNull() | (F.col(value) <= F.col("cut"))).drop("_key")


def rtf_summary(calls: DataFrame, key: str, digits: int = 6) -> DataFrame:
    r = lambda c: F.round(c, digits)
    return calls.groupBy(key).agg(F.count("*").alias("n"), r(F.avg("rtf")).alias("mean_rtf"), r(F.median("rtf")).alias("median_rtf"), r(F.sum("seconds") / F.sum("audio_sec")).alias("overall_rtf"))


def spans(segments: DataFrame, key: str, start: str, duration: Column) -> DataFrame:
    """end_s of each segment: the next one's start, for the last one the duration."""
    return segments.withColumn("_end", duration).withColumn("end_s", F.coalesce(F.lead(start).over(W.partitionBy(key).orderBy(start)), F.col("_end"))).drop("_end")
