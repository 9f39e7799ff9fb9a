"""Speech recognition metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_text, tenth_bin
from ..functions.udfs import word_edits
from .confusion import ratio


def word_error_rate(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Adds edits, ref_words and wer; an empty reference has none, and a long hypothesis may exceed 1."""
    words = F.size(F.filter(F.split(normal_text(F.col(ref)), " "), lambda w: w != ""))
    edits = pairs.withColumn("edits", word_edits(ref, hyp)).withColumn("ref_words", words)
    wrong = F.col("edits.substitutions") + F.col("edits.deletions") + F.col("edits.insertions")
    return edits.withColumn("wer", ratio(wrong, F.col("ref_words")))


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance of the normalised characters without blanks, per reference character."""
    squeeze = lambda c: F.replace(normal_text(c), F.lit(" "), F.lit(""))
    return ratio(F.levenshtein(squeeze(ref), squeeze(hyp)), F.length(squeeze(ref)))


def preserved(excerpt: Column, hyp: Column, least: float = 0.7) -> Column:
    """Whether at least 70 % of an excerpt's words occur in the hypothesis; null for an excerpt without words."""
    words = F.filter(F.split(normal_text(excerpt), " "), lambda w: w != "")
    known = F.split(normal_text(hyp), " ")
    hits = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    return F.when(F.size(words) > 0, hits / F.size(words) >= least)


def boundary_corruption(segments: DataFrame, key: str, chunk: float) -> DataFrame:
    """Chunk borders of a recording, and those that fall strictly inside a segment.

    ``segments``: key, start_s, duration_s. A recording with one segment has no span and so no corrupted border.
    """
    per = segments.groupBy(key).agg(F.array_sort(F.collect_list("start_s")).alias("starts"), F.max("duration_s").alias("dur"))
    borders = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("dur") / chunk).cast("int"), F.lit(1))), lambda k: k * chunk), lambda b: b < F.col("dur"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("dur"))
    spans = F.when(F.size("starts") > 1, F.arrays_zip(F.col("starts").alias("s"), ends.alias("e"))).otherwise(F.array().cast("array<struct<s: double, e: double>>"))
    marked = per.select(key, borders.alias("borders"), spans.alias("spans"))
    bad = F.filter("borders", lambda b: F.exists("spans", lambda x: (x["s"] + 0.5 < b) & (b < x["e"] - 0.05)))
    return marked.select(key, F.size("borders").alias("n_boundaries"), F.size(bad).alias("n_corrupted")).withColumn("rate", ratio(F.col("n_corrupted"), F.col("n_boundaries")))


def micro_average(value: Column, weight: Column) -> Column:
    """Weighted mean that skips rows without weight or value."""
    return ratio(F.sum(F.when((weight > 0) & value.isNotNull(), value * weight)), F.sum(F.when((weight > 0) & value.isNotNull(), weight)))


def bucket_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(tenth_bin(F.col(by)).alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def semantic_error_rate(affected: Column, reference: Column) -> Column:
    """Affected words per reference word, at most 1 and not below 0; null without reference."""
    return F.when(reference > 0, F.least(F.lit(1.0), F.greatest(affected, F.lit(0)) / reference))


def translation_summary(calls: DataFrame, keys: list[str], statuses: list[str]) -> DataFrame:
    """Per group: micro, mean and median error rate, shares of kept and lost tone and intent, and of the moments' statuses.

    ``calls``: the keys, ser, aff, ref_words, tone, intent and moments (array of statuses).
    """
    share = lambda c, answer: F.avg((F.col(c) == answer).cast("double")).alias(f"{c}_{answer}")
    total = F.sum(F.size("moments"))
    rate = lambda s: ratio(F.sum(F.size(F.filter("moments", lambda m: m == s))), total).alias(f"{s}_rate")
    return calls.groupBy(*keys).agg(
        F.count("*").alias("n"), ratio(F.sum("aff"), F.sum("ref_words")).alias("micro_ser"), F.avg("ser").alias("mean_ser"), F.median("ser").alias("median_ser"),
        *[share(c, a) for c in ("tone", "intent") for a in ("yes", "no")], total.cast("long").alias("moments"), *[rate(s) for s in statuses],
    )
