"""Scoring modes, post-processing rules and verdict checks on flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ["PlatformMove", "SuspiciousActivity", "Explicit-Flirting"]
CAP = 0.3
MODES = ["raw", "sa", "sa_drop_invalid", "pp_full"]
#: prompt version -> fields of its flags; availability follows the version, never the data
PROMPT_FIELDS = {
    **{v: frozenset() for v in ("v1", "v2", "v3", "v5")},
    "v4": frozenset({"speech_act", "violation", "quote_type"}),
    **{v: frozenset({"speech_act", "violation", "spk"}) for v in ("v6", "v7", "v8")},
}
FP_TYPES = ["GT_MISS", "WRONG_CATEGORY", "MATCHER_MISS", "DUPLICATE_OR_EXTRA_INSTANCE", "UNCLEAR"]


def has_field(prompt: Column, field: str) -> Column:
    """Whether a prompt version declares a field; an unknown version is an error."""
    with_field = [v for v, fields in PROMPT_FIELDS.items() if field in fields]
    known = prompt.isin(*PROMPT_FIELDS)
    return F.when(known, prompt.isin(*with_field)).otherwise(F.raise_error(F.concat(F.lit("unknown prompt version: "), F.coalesce(prompt, F.lit("null")))).cast("boolean"))


def passes(score: Column, threshold: Column) -> Column:
    """A null threshold passes everything; a missing score passes no number."""
    return threshold.isNull() | F.coalesce(score >= threshold, F.lit(False))


def valid_category(category: Column) -> Column:
    return F.coalesce(category.isin(*CATEGORIES), F.lit(False))


def with_modes(flags: DataFrame) -> DataFrame:
    """Adds score_<mode> for every mode, and ``dropped`` for the modes that drop invalid categories."""
    capped = lambda when, value: F.when(when, F.least(value, F.lit(CAP))).otherwise(value)
    conf = F.coalesce("confidence", F.lit(0.0))
    act = F.col("speech_act").isNull() | F.col("speech_act").isin("reported", "denial")
    sa = capped(has_field(F.col("prompt"), "speech_act") & act, conf)
    sa = capped(has_field(F.col("prompt"), "spk") & F.coalesce(F.col("speaker") == "unclear", F.lit(False)), sa)
    full = capped(has_field(F.col("prompt"), "violation") & F.coalesce(F.col("violation") == "no", F.lit(False)), sa)
    return flags.withColumns({"score_raw": F.col("confidence"), "score_sa": sa, "score_sa_drop_invalid": sa, "score_pp_full": full, "dropped": ~valid_category(F.col("category"))})


def by_mode(flags: DataFrame) -> DataFrame:
    """One row per flag and mode: mode, score, and whether the mode drops the flag."""
    scored = with_modes(flags)
    options = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"score_{m}").alias("score"), (F.lit(m in MODES[2:]) & F.col("dropped")).alias("is_dropped")) for m in MODES])
    rest = [c for c in scored.columns if not c.startswith("score_") and c != "dropped"]
    return scored.select(*rest, F.explode(options).alias("m")).select(*rest, "m.mode", "m.score", "m.is_dropped")


def post_process(flags: DataFrame, rule_set: str) -> DataFrame:
    """pp_confidence, pp_dropped and pp_rules of a rule set: none, pp_v1 or pp_v1_noviol."""
    if rule_set not in ("none", "pp_v1", "pp_v1_noviol"):
        raise ValueError(f"unknown rule set {rule_set}")
    if rule_set == "none":
        return flags.withColumns({"pp_confidence": F.col("confidence"), "pp_dropped": F.lit(False), "pp_rules": F.array().cast("array<string>")})
    dropped = ~valid_category(F.col("category"))
    conf = F.coalesce("confidence", F.lit(0.0))
    act = F.coalesce(F.col("speech_act").isin("reported", "denial"), F.lit(False))
    after = F.when(act, F.least(conf, F.lit(CAP))).otherwise(conf)
    viol = F.coalesce(F.col("violation") == "no", F.lit(False)) if rule_set == "pp_v1" else F.lit(False)
    final = F.when(viol, F.least(after, F.lit(CAP))).otherwise(after)
    rules = F.array_compact(F.array(F.when(dropped, "category_drop"), F.when(act & (conf > CAP), "speech_act_cap"), F.when(viol & (after > CAP), "violation_cap")))
    return flags.withColumns({"pp_confidence": final, "pp_dropped": dropped, "pp_rules": rules})


def redundant(matched: str = "matched", fp_type: str = "fp_type") -> Column:
    """An unmatched flag that was judged an extra instance of a violation caught already."""
    return ~F.col(matched) & F.coalesce(F.col(fp_type) == "DUPLICATE_OR_EXTRA_INSTANCE", F.lit(False))


def composite(base: Column, category: Column, about: Column, quote: Column) -> Column:
    """Base score times cat * (1 - about) * quote; an unsent part counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(base) * zero(category) * (1 - zero(about)) * zero(quote)


def checked_verdict(fp_type: Column) -> Column:
    """A verdict outside the taxonomy becomes UNCLEAR."""
    return F.when(fp_type.isin(*FP_TYPES), fp_type).otherwise("UNCLEAR")


def enforce_duplicates(verdicts: DataFrame, matched_gt: DataFrame) -> DataFrame:
    """A duplicate must point at a matched reference flag, else it is a matcher miss.

    ``verdicts``: run_key, file_id, fp_type, related_gt, verified; ``matched_gt``: run_key, file_id, gt_index.
    Where the matched set is not verified the type stays and the confidence is low.
    """
    keys = matched_gt.select("run_key", "file_id", F.col("gt_index").alias("related_gt")).distinct().withColumn("is_matched", F.lit(True))
    joined = verdicts.join(keys, ["run_key", "file_id", "related_gt"], "left")
    duplicate = F.col("fp_type") == "DUPLICATE_OR_EXTRA_INSTANCE"
    wrong = F.col("verified") & duplicate & F.col("is_matched").isNull()
    low = ~F.col("verified") & F.col("fp_type").isin("DUPLICATE_OR_EXTRA_INSTANCE", "MATCHER_MISS")
    return joined.withColumn("final_type", F.when(wrong, "MATCHER_MISS").otherwise(F.col("fp_type"))).withColumn("low_confidence", low).drop("is_matched")
