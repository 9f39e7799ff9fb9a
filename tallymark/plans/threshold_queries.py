"""Threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators import thresholds as T
from ..sources import fixtures as X
from .base import query
from .confusion_queries import CATS, MODES, tables

RATIOS = """tp / nullif(tp + fp, 0)::double as precision, tp / nullif(tp + fn, 0)::double as recall, tn / nullif(tn + fp, 0)::double as specificity, (tp + tn) / nullif(tp + fp + fn + tn, 0)::double as accuracy,
  case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) end as f1, loose_tp / nullif(n_gt_pos, 0)::double as loose_recall,
  (flag_tp + flag_redundant) / nullif(flag_tp + flag_redundant + flag_fp, 0)::double as flag_precision, flag_tp / nullif(flag_tp + flag_fn, 0)::double as flag_recall"""
NAMES = ", ".join([*T.SWEEP_COUNTS, *T.SWEEP_RATIOS])


def sweep_sql(flags: str, score: str, grid: list[float], files: str = "fx_files", keys: str = "run_key", langs: bool = True) -> str:
    """Brute force: every file and flag against every threshold."""
    values = ", ".join(["(null::double)", *(f"({t}::double)" for t in grid)])
    lang = "unnest([language, 'ALL'])" if langs else "'ALL'"
    return f"""
fl as (select *, {score} as score from {flags}),
th(threshold) as (values {values}),
cell as (select f.*, cat, threshold, (select count(*) from fx_gt g where g.file_id = f.file_id and (cat = 'ALL' or g.category = cat)) as n_gt from {files} f, {CATS}, th),
hit as (select {", ".join("c." + k for k in keys.split(", "))}, c.file_id, c.language, c.cat, c.threshold, n_gt,
  coalesce(bool_or(on_ and matched and (cat = 'ALL' or matched_gt_category = cat)), false) as strict_, coalesce(bool_or(on_ and own), false) as loose_,
  count(*) filter (where on_ and own and matched) as ftp, count(*) filter (where on_ and own and not matched and coalesce(fp_type <> 'DUPLICATE_OR_EXTRA_INSTANCE', true)) as ffp,
  count(*) filter (where on_ and own and fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE') as fred, count(*) filter (where own and score is null and event_id is not null) as miss
  from (select c.*, s.event_id, s.matched, s.matched_gt_category, s.fp_type, s.score, event_id is not null and (threshold is null or coalesce(score >= threshold, false)) as on_, cat = 'ALL' or s.category = cat as own from cell c left join fl s on {" and ".join(f"s.{k} = c.{k}" for k in keys.split(", ") if k in ("run_key", "mode"))} and s.file_id = c.file_id) c group by all),
sw as (select {keys}, {lang} as language, cat as category, threshold, n_gt, strict_, loose_, ftp, ffp, fred, miss from hit),
agg as (select {keys}, language, category, threshold, count(*) filter (where n_gt > 0) as n_gt_pos, count(*) filter (where n_gt = 0) as n_gt_neg, count(*) filter (where n_gt > 0 and strict_) as tp, count(*) filter (where n_gt = 0 and loose_) as fp,
  count(*) filter (where n_gt > 0 and not strict_) as fn, count(*) filter (where n_gt = 0 and not loose_) as tn, count(*) filter (where n_gt > 0 and loose_) as loose_tp,
  sum(ftp)::bigint as flag_tp, sum(ffp)::bigint as flag_fp, sum(fred)::bigint as flag_redundant, (sum(n_gt) - sum(ftp))::bigint as flag_fn, sum(miss)::bigint as n_missing from sw group by all),
sweep as (select *, {RATIOS} from agg)"""


def _sweep(spark, d, score, grid):
    files, gt, flags = tables(spark, d)
    return T.sweep(files, gt, flags, score, grid).select("run_key", "language", "category", "threshold", *T.SWEEP_COUNTS, *T.SWEEP_RATIOS)


@query("a13_threshold_metrics", f"with {sweep_sql('fx_scored', 'confidence', T.TENTHS)} select run_key, language, category, threshold, {NAMES} from sweep", fx=True)
def a13_threshold_metrics(spark, d):
    return _sweep(spark, d, "confidence", T.TENTHS)


@query("a14_threshold_metrics_logprob", f"with {sweep_sql('fx_scored', 'logprob_confidence', T.TENTHS)} select run_key, language, category, threshold, {NAMES} from sweep", fx=True)
def a14_threshold_metrics_logprob(spark, d):
    return _sweep(spark, d, "logprob_confidence", T.TENTHS)


@query("a14_threshold_metrics_entropy", f"with {sweep_sql('fx_scored', '-entropy_mean', T.ENTROPY)} select run_key, language, category, threshold, {NAMES} from sweep", fx=True)
def a14_threshold_metrics_entropy(spark, d):
    files, gt, flags = tables(spark, d)
    return T.sweep(files, gt, flags.withColumn("score", -F.col("entropy_mean")), "score", T.ENTROPY).select("run_key", "language", "category", "threshold", *T.SWEEP_COUNTS, *T.SWEEP_RATIOS)


@query("a15_threshold_metrics_pp", f"""with pp0 as (select * from fx_scored where category in ('PlatformMove', 'SuspiciousActivity', 'Explicit-Flirting')),
pp1 as (select *, case when speech_act in ('reported', 'denial') then least(coalesce(confidence, 0), 0.3) else coalesce(confidence, 0) end as c1 from pp0), pp2 as (select *, case when violation = 'no' then least(c1, 0.3) else c1 end as c2 from pp1),
{sweep_sql('pp2', 'c2', T.TENTHS)} select run_key, language, category, threshold, {NAMES} from sweep""", fx=True)
def a15_threshold_metrics_pp(spark, d):
    files, gt, flags = tables(spark, d)
    kept = S.post_process(flags, "pp_v1").where("not pp_dropped")
    return T.sweep(files, gt, kept, "pp_confidence", T.TENTHS).select("run_key", "language", "category", "threshold", *T.SWEEP_COUNTS, *T.SWEEP_RATIOS)


def mode_sweep(spark, d):
    """All scoring modes in one sweep: the mode is part of the run key."""
    files, gt, flags = tables(spark, d)
    joint = F.concat_ws("|", "run_key", "mode")
    kept = S.by_mode(flags).where("not is_dropped").withColumn("run_key", joint)
    cells = files.select("*", F.explode(F.array(*map(F.lit, S.MODES))).alias("mode")).withColumn("run_key", joint).drop("mode")
    out = T.sweep(cells, gt, kept, "score", T.TENTHS)
    return out.withColumn("mode", F.element_at(F.split("run_key", "[|]"), 2)).withColumn("run_key", F.element_at(F.split("run_key", "[|]"), 1))


MODE_FILES = "mode_files as (select f.*, mode from fx_files f cross join (values ('raw'), ('sa'), ('sa_drop_invalid'), ('pp_full')) m(mode)), kept as (select * exclude (score), score as mode_score from modes where not is_dropped)"


@query("a16_all_modes_thresholds", f"with {MODES}, {MODE_FILES}, {sweep_sql('kept', 'mode_score', T.TENTHS, files='mode_files', keys='run_key, mode')} select run_key, mode, language, category, threshold, {NAMES} from sweep", fx=True)
def a16_all_modes_thresholds(spark, d):
    return mode_sweep(spark, d).select("run_key", "mode", "language", "category", "threshold", *T.SWEEP_COUNTS, *T.SWEEP_RATIOS)


@query("a16_kept_and_dropped", f"with {MODES} select run_key, mode, count(*) filter (where not is_dropped) as kept, count(*) filter (where is_dropped) as dropped, bool_or(fp_type is not null) as redundant_available from modes group by 1, 2", fx=True)
def a16_kept_and_dropped(spark, d):
    m = S.by_mode(tables(spark, d)[2])
    return m.groupBy("run_key", "mode").agg(F.count_if(~F.col("is_dropped")).alias("kept"), F.count_if("is_dropped").alias("dropped"), F.bool_or(F.col("fp_type").isNotNull()).alias("redundant_available"))


@query("a24_fixed_thresholds", f"with {sweep_sql('fx_scored', 'confidence', [0.8, 0.9])} select run_key, category, threshold, tp, fp, fn, tn, recall, specificity from sweep where language = 'ALL' and threshold is not null", fx=True)
def a24_fixed_thresholds(spark, d):
    files, gt, flags = tables(spark, d)
    out = T.sweep(files, gt, flags, "confidence", [0.8, 0.9])
    return out.where("language = 'ALL' and threshold is not null").select("run_key", "category", "threshold", "tp", "fp", "fn", "tn", "recall", "specificity")


SEGMENTED = """
med as (select median(duration_s) as md, median(snr_db) as ms from fx_segments),
gmax as (select file_id, count(*) as n, max(confidence) as c from fx_gt group by 1),
seg as (select s.file_id, duration_s, snr_db, case when duration_s < md then 'short' else 'long' end as length_segment, case when snr_db is null then null when snr_db < ms then 'bad' else 'good' end as quality_segment,
  case when g.n is null then null when g.c >= 0.8 then 'clear_violation' else 'ambiguous_violation' end as difficulty_segment from fx_segments s left join gmax g using (file_id), med)"""


def segmented(spark, d):
    """Length and quality split at the median, difficulty by the surest reference flag; a missing measure has no segment."""
    b = X.base(spark, d)
    seg = X.segments(b)
    med = seg.agg(F.median("duration_s").alias("md"), F.median("snr_db").alias("ms"))
    best = X.gt_flags(b).groupBy("file_id").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    joined = seg.join(best, "file_id", "left").crossJoin(F.broadcast(med))
    return joined.select(
        "file_id", "duration_s", "snr_db", F.when(F.col("duration_s") < F.col("md"), "short").otherwise("long").alias("length_segment"),
        F.when(F.col("snr_db").isNull(), None).when(F.col("snr_db") < F.col("ms"), "bad").otherwise("good").alias("quality_segment"),
        F.when(F.col("n").isNull(), None).when(F.col("c") >= 0.8, "clear_violation").otherwise("ambiguous_violation").alias("difficulty_segment"),
    )


@query("a25_audio_segments", f"with {SEGMENTED} select file_id, duration_s, snr_db, length_segment, quality_segment, difficulty_segment from seg", fx=True)
def a25_audio_segments(spark, d):
    return segmented(spark, d)


AXES = "ax as (select file_id, unnest(['length', 'quality', 'difficulty']) as axis, unnest([length_segment, quality_segment, difficulty_segment]) as segment from seg), axf as (select f.*, axis, segment from fx_files f join ax using (file_id) where segment is not null)"


@query("j10_segment_axes", f"with {SEGMENTED}, {AXES} select run_key, file_id, axis, segment from axf", fx=True)
def j10_segment_axes(spark, d):
    return attach(tables(spark, d)[0], segmented(spark, d)).select("run_key", "file_id", "axis", "segment")


def attach(files, seg):
    """Files under each of their segments; a missing segment is left out."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_segment").alias("segment")) for a in ("length", "quality", "difficulty")])
    long = seg.select("file_id", F.explode(axes).alias("a")).select("file_id", "a.axis", "a.segment").where("segment is not null")
    return files.join(long, "file_id")


@query("a26_thresholds_by_segment", f"with {SEGMENTED}, {AXES}, {sweep_sql('fx_scored', 'confidence', [0.6, 0.8, 0.9], files='axf', keys='run_key, axis, segment', langs=False)} select run_key, axis, segment, category, threshold, {', '.join(T.SWEEP_COUNTS)}, recall, specificity from sweep", fx=True)
def a26_thresholds_by_segment(spark, d):
    files, gt, flags = tables(spark, d)
    cells = attach(files.drop("language"), segmented(spark, d))
    return segment_sweep(cells, gt, flags).select("run_key", "axis", "segment", "category", "threshold", *T.SWEEP_COUNTS, "recall", "specificity")


def segment_sweep(cells, gt, flags):
    return T.sweep(cells, gt, flags, "confidence", [0.6, 0.8, 0.9], keys=("run_key", "axis", "segment"), all_keys=())


@query("a31_heldout_thresholds_by_segment", f"with {SEGMENTED}, {AXES}, held as (select * from axf where user_id % 8 <> 0), {sweep_sql('fx_scored', 'confidence', [0.6, 0.8, 0.9], files='held', keys='run_key, axis, segment', langs=False)} select run_key, axis, segment, category, threshold, tp, fp, fn, tn, recall, case when axis <> 'difficulty' then specificity end as specificity from sweep", fx=True)
def a31_heldout_thresholds_by_segment(spark, d):
    files, gt, flags = tables(spark, d)
    dev = files.where("user_id % 8 = 0").select("file_id").distinct()
    cells = attach(files.drop("language"), segmented(spark, d)).join(dev, "file_id", "left_anti")
    out = segment_sweep(cells, gt, flags)
    return out.select("run_key", "axis", "segment", "category", "threshold", "tp", "fp", "fn", "tn", "recall", F.when(F.col("axis") != "difficulty", F.col("specificity")).alias("specificity"))


@query("r12_monotonicity", f"with {sweep_sql('fx_scored', 'confidence', T.TENTHS)}, l as (select *, lag(tp) over w as tp0, lag(fp) over w as fp0, lag(tn) over w as tn0 from sweep window w as (partition by run_key, language, category order by threshold nulls first)) select run_key, language, category, threshold from l where tp > tp0 or fp > fp0 or tn < tn0", fx=True)
def r12_monotonicity(spark, d):
    return T.rises(_sweep(spark, d, "confidence", T.TENTHS), ["run_key", "language", "category"]).select("run_key", "language", "category", "threshold")


@query("r12_planted_rise", f"with {sweep_sql('fx_scored', 'confidence', T.TENTHS)}, p as (select run_key, language, category, threshold, case when threshold = 0.5 and category = 'ALL' then tp + 1000 else tp end as tp, fp, case when threshold = 0.7 and language = 'tamil' then -1 else tn end as tn from sweep), l as (select *, lag(tp) over w as tp0, lag(fp) over w as fp0, lag(tn) over w as tn0 from p window w as (partition by run_key, language, category order by threshold nulls first)) select run_key, language, category, threshold from l where tp > tp0 or fp > fp0 or tn < tn0", fx=True)
def r12_planted_rise(spark, d):
    """The check of monotonicity finds what was put wrong into a sweep."""
    s = _sweep(spark, d, "confidence", T.TENTHS)
    wrong = s.withColumn("tp", F.when((F.col("threshold") == 0.5) & (F.col("category") == "ALL"), F.col("tp") + 1000).otherwise(F.col("tp"))).withColumn("tn", F.when((F.col("threshold") == 0.7) & (F.col("language") == "tamil"), -1).otherwise(F.col("tn")))
    return T.rises(wrong, ["run_key", "language", "category"]).select("run_key", "language", "category", "threshold")


#: the row of the entropy grid that stands beside each row of the other signals; fixed values
BESIDE = [(None, None), (0.0, 0.0), (0.1, -2.0), (0.2, -1.0), (0.3, -0.5), (0.4, -0.25), (0.5, -0.1), (0.6, -0.05), (0.7, -0.02), (0.8, -0.01), (0.9, 0.0)]
BLOCK = ["tp", "fp", "fn", "tn", "precision", "recall", "specificity", "accuracy"]
SIGNALS = {"conf": ("confidence", T.TENTHS), "logp": ("logprob_confidence", T.TENTHS), "entr": ("-entropy_mean", T.ENTROPY)}
_BESIDE_SQL = ", ".join(f"({'null' if t is None else t}::double, {'null' if e is None else e}::double)" for t, e in BESIDE)


@query("v1_threshold_pivot", "with " + ", ".join(f"{n} as (select * from (with {sweep_sql('fx_scored', e, g)} select * from sweep) where language = 'ALL')" for n, (e, g) in SIGNALS.items()) + f""", be(t, e) as (values {_BESIDE_SQL})
select conf.run_key, conf.category, conf.threshold, conf.n_gt_pos, conf.n_gt_neg, {", ".join(f"{n}.{c} as {n}_{c}" for n in SIGNALS for c in BLOCK)} from conf join be on be.t is not distinct from conf.threshold
 left join logp on logp.run_key = conf.run_key and logp.category = conf.category and logp.threshold is not distinct from be.t left join entr on entr.run_key = conf.run_key and entr.category = conf.category and entr.threshold is not distinct from be.e""", fx=True)
def v1_threshold_pivot(spark, d):
    """A row a category and threshold, the three signals beside each other; entropy has a grid of its own, placed by position."""
    files, gt, flags = tables(spark, d)
    scored = flags.withColumn("neg_entropy", -F.col("entropy_mean"))
    block = lambda n, score, grid: T.sweep(files, gt, scored, score, grid, keys=("run_key",), all_keys=()).select("run_key", "category", F.col("threshold").alias(f"{n}_at"), "n_gt_pos", "n_gt_neg", *[F.col(c).alias(f"{n}_{c}") for c in BLOCK])
    beside = spark.createDataFrame(BESIDE, "threshold double, at_entropy double")
    conf = block("conf", "confidence", T.TENTHS).join(F.broadcast(beside), F.col("threshold").eqNullSafe(F.col("conf_at"))).drop("conf_at")
    out = conf
    for n, score, grid, at in (("logp", "logprob_confidence", T.TENTHS, "threshold"), ("entr", "neg_entropy", T.ENTROPY, "at_entropy")):
        other = block(n, score, grid).drop("n_gt_pos", "n_gt_neg").withColumnsRenamed({"run_key": f"{n}_run", "category": f"{n}_cat"})
        out = out.join(other, (F.col(f"{n}_run") == F.col("run_key")) & (F.col(f"{n}_cat") == F.col("category")) & F.col(f"{n}_at").eqNullSafe(F.col(at)), "left").drop(f"{n}_run", f"{n}_cat", f"{n}_at")
    return out.drop("at_entropy")


def one_matcher(rows, current: str):
    """Rows of one matcher version a prompt; more than one is an error. Adds whether it is the current one."""
    from pyspark.sql import Window as Win

    of_prompt = Win.partitionBy("prompt")
    several = F.min("matcher_version").over(of_prompt) != F.max("matcher_version").over(of_prompt)
    wrong = F.raise_error(F.concat(F.lit("several matcher versions for prompt "), "prompt")).cast("string")
    checked = rows.withColumn("matcher_version", F.when(several, wrong).otherwise(F.col("matcher_version")))
    return checked.withColumn("current", F.col("matcher_version") == current)


PROMPT_OF = "case run_key when 'm1' then 'v3' when 'm2' then 'v4' else 'v6' end"
VERSION_OF = "case run_key when 'm2' then 'k1' else 'k2' end"


@query("v5_cross_prompt_summary", f"with {MODES}, {MODE_FILES}, {sweep_sql('kept', 'mode_score', [0.6, 0.8, 0.9], files='mode_files', keys='run_key, mode')} select run_key, {PROMPT_OF} as prompt, {VERSION_OF} as matcher_version, run_key <> 'm2' as current, mode, threshold, recall, specificity, precision, flag_precision, fp as fp_files, fn as fn_files, flag_tp + flag_fp as n_flags from sweep where language = 'ALL' and category = 'ALL'", fx=True)
def v5_cross_prompt_summary(spark, d):
    """Whole-run rows of all prompts and modes, after a check that each prompt was scored by one matcher version."""
    s = mode_sweep(spark, d).where("language = 'ALL' and category = 'ALL'").where("threshold is null or threshold in (0.6D, 0.8D, 0.9D)")
    named = s.withColumn("prompt", F.expr(PROMPT_OF)).withColumn("matcher_version", F.expr(VERSION_OF))
    return one_matcher(named, "k2").select("run_key", "prompt", "matcher_version", "current", "mode", "threshold", "recall", "specificity", "precision", "flag_precision", F.col("fp").alias("fp_files"), F.col("fn").alias("fn_files"), (F.col("flag_tp") + F.col("flag_fp")).alias("n_flags"))


@query("r8_best_modes", f"with {MODES}, {MODE_FILES}, {sweep_sql('kept', 'mode_score', [0.6, 0.8, 0.9], files='mode_files', keys='run_key, mode')}, k as (select run_key, threshold, mode, recall, specificity, flag_precision, row_number() over (partition by run_key, threshold order by recall desc nulls last, specificity desc nulls last, flag_precision desc nulls last, mode) as by_recall, row_number() over (partition by run_key, threshold order by specificity desc nulls last, recall desc nulls last, mode) as by_specificity, row_number() over (partition by run_key, threshold order by flag_precision desc nulls last, recall desc nulls last, mode) as by_flag_precision from sweep where language = 'ALL' and category = 'ALL' and threshold is not null) select * from k where least(by_recall, by_specificity, by_flag_precision) <= 3", fx=True)
def r8_best_modes(spark, d):
    """The three best modes of each run and threshold by recall, by specificity and by flag precision."""
    s = mode_sweep(spark, d).where("language = 'ALL' and category = 'ALL' and threshold in (0.6D, 0.8D, 0.9D)")
    place = lambda *by: F.row_number().over(W.partitionBy("run_key", "threshold").orderBy(*[F.desc_nulls_last(c) for c in by], "mode"))
    ranked = s.withColumns({"by_recall": place("recall", "specificity", "flag_precision"), "by_specificity": place("specificity", "recall"), "by_flag_precision": place("flag_precision", "recall")})
    return ranked.where(F.least("by_recall", "by_specificity", "by_flag_precision") <= 3).select("run_key", "threshold", "mode", "recall", "specificity", "flag_precision", "by_recall", "by_specificity", "by_flag_precision")
