"""Leaderboards and report pivots."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import confusion as C
from ..operators import scoring as S
from ..operators import thresholds as T
from ..sources import fixtures as X
from ..sources import io
from .base import query
from .confusion_queries import DECILE, FILE_STATE, MODES, tables
from .threshold_queries import SEGMENTED, segmented, sweep_sql

GOOD = "(matched or coalesce(fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE', false))"
FLAGM = f"""
fm as (select run_key, count(*) as n_flags, count(*) filter (where {GOOD}) as right_, count(*) filter (where confidence >= 0.8) as hi_n, count(*) filter (where confidence >= 0.8 and {GOOD}) as hi_ok from fx_scored group by 1),
fmr as (select run_key, n_flags, right_ / nullif(n_flags, 0)::double as flag_precision, hi_ok / nullif(hi_n, 0)::double - coalesce((right_ - hi_ok) / nullif(n_flags - hi_n, 0)::double, 0) as precision_gap, hi_ok / nullif(right_, 0)::double as right_flags_high from fm)"""


def flag_metrics(flags, high: float = 0.8):
    """Precision of all flags, its gap between sure and other flags, and the share of right flags that are sure."""
    good, sure = F.col("matched") | S.redundant(), F.coalesce(F.col("confidence") >= high, F.lit(False))
    m = flags.groupBy("run_key").agg(F.count("*").alias("n_flags"), F.count_if(good).alias("right"), F.count_if(sure).alias("hi_n"), F.count_if(sure & good).alias("hi_ok"))
    low = C.ratio(F.col("right") - F.col("hi_ok"), F.col("n_flags") - F.col("hi_n"))
    return m.select("run_key", "n_flags", C.ratio(F.col("right"), F.col("n_flags")).alias("flag_precision"), (C.ratio(F.col("hi_ok"), F.col("hi_n")) - F.coalesce(low, F.lit(0.0))).alias("precision_gap"), C.ratio(F.col("hi_ok"), F.col("right")).alias("right_flags_high"))


@query("a27_flag_metrics", f"with {FLAGM} select * from fmr", fx=True)
def a27_flag_metrics(spark, d):
    return flag_metrics(tables(spark, d)[2])


FULL = "kept as (select * exclude (score), score as s from modes where mode = 'pp_full' and not is_dropped)"


def full_mode(flags):
    return S.with_modes(flags).where("not dropped")


@query("a28_leaderboard", f"""with {MODES}, {FULL}, {FLAGM}, {SEGMENTED}, {sweep_sql('kept', 's', [0.8])},
amb_files as (select f.* from fx_files f join seg using (file_id) where difficulty_segment = 'ambiguous_violation'),
amb as (select a.run_key, count(*) filter (where exists (select 1 from kept k where k.run_key = a.run_key and k.file_id = a.file_id and k.matched and k.s >= 0.8)) / count(*)::double as ambiguous_recall from amb_files a group by 1),
l as (select s.run_key, n_gt_pos + n_gt_neg as calls, (recall + specificity) / 2 as balanced_acc, recall, specificity, ambiguous_recall, flag_precision_all, precision_gap, right_flags_high from sweep s left join amb using (run_key) join (select run_key, flag_precision as flag_precision_all, precision_gap, right_flags_high from fmr) using (run_key) where language = 'ALL' and category = 'ALL' and threshold = 0.8)
select *, row_number() over (order by coalesce(balanced_acc, 0) desc, run_key) as place, calls < 0.9 * 381 as partial from l""", fx=True)
def a28_leaderboard(spark, d):
    files, gt, flags = tables(spark, d)
    hard = segmented(spark, d).where("difficulty_segment = 'ambiguous_violation'").select("file_id", F.lit("hard").alias("kind"))
    kinds = files.join(hard, "file_id", "left").fillna("other", ["kind"])
    # one sweep: all files, and the hard ones by themselves
    both = T.sweep(kinds, gt, full_mode(flags), "score_pp_full", [0.8], keys=("run_key", "kind"), all_keys=("kind",)).where("category = 'ALL' and threshold = 0.8D")
    at, amb = both.where("kind = 'ALL'"), both.where("kind = 'hard'").select("run_key", F.col("recall").alias("ambiguous_recall"))
    fm = flag_metrics(flags).select("run_key", F.col("flag_precision").alias("flag_precision_all"), "precision_gap", "right_flags_high")
    rows = at.select("run_key", (F.col("n_gt_pos") + F.col("n_gt_neg")).alias("calls"), ((F.col("recall") + F.col("specificity")) / 2).alias("balanced_acc"), "recall", "specificity").join(amb, "run_key", "left").join(fm, "run_key")
    place = F.row_number().over(W.orderBy(F.coalesce("balanced_acc", F.lit(0.0)).desc(), "run_key"))  # one row a run
    return rows.withColumn("place", place).withColumn("partial", F.col("calls") < 0.9 * 381)


@query("a30_gt_consistency", "with h as (select r, file_id, md5(string_agg(category || t_sec || case when r = 3 and event_id % 64 = 0 then 'x' else '' end, '|' order by event_id)) as h from fx_gt cross join (values (1), (2), (3)) v(r) group by 1, 2) select file_id, count(distinct h) as n_versions from h group by 1 having count(distinct h) > 1", fx=True)
def a30_gt_consistency(spark, d):
    """Files whose reference flags differ between runs, by a digest of the ordered flags."""
    runs = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("r")
    g = X.gt_flags(X.base(spark, d)).select("*", runs)
    text = F.concat("category", F.col("t_sec").cast("string"), F.when((F.col("r") == 3) & (F.col("event_id") % 64 == 0), "x").otherwise(""))
    flags = F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("v")))), lambda s: s["v"])
    h = g.groupBy("r", "file_id").agg(F.md5(F.array_join(flags, "|").cast("binary")).alias("h"))
    return h.groupBy("file_id").agg(F.count_distinct("h").alias("n_versions")).where("n_versions > 1")


@query("v4_wide_overview", f"with {sweep_sql('fx_scored', 'confidence', [0.6, 0.8, 0.9])} select run_key, category, max(recall) filter (where threshold = 0.6) as t06_recall, max(specificity) filter (where threshold = 0.6) as t06_specificity, max(recall) filter (where threshold = 0.8) as t08_recall, max(specificity) filter (where threshold = 0.8) as t08_specificity from sweep where language = 'ALL' group by 1, 2", fx=True)
def v4_wide_overview(spark, d):
    files, gt, flags = tables(spark, d)
    s = T.sweep(files, gt, flags, "confidence", [0.6, 0.8, 0.9], keys=("run_key",), all_keys=()).where("threshold in (0.6D, 0.8D)")
    named = s.withColumn("t", F.when(F.col("threshold") == 0.6, "t06").otherwise("t08"))
    return named.groupBy("run_key", "category").pivot("t", ["t06", "t08"]).agg(F.max("recall").alias("recall"), F.max("specificity").alias("specificity"))


@query("e9_scored_map", f"with {MODES} select event_id, max(score) filter (where mode = 'raw') as raw, max(score) filter (where mode = 'sa') as sa, max(score) filter (where mode = 'pp_full') as pp_full from modes group by 1", fx=True)
def e9_scored_map(spark, d):
    m = S.with_modes(tables(spark, d)[2])
    scored = m.select("event_id", F.map_from_arrays(F.array(*map(F.lit, S.MODES)), F.array(*[F.col(f"score_{x}") for x in S.MODES])).alias("scored"))
    return scored.select("event_id", *[F.col("scored").getItem(x).alias(x) for x in ("raw", "sa", "pp_full")])


@query("e10_mode_deciles", f"with {MODES}, k as (select run_key, {DECILE.format(c='score')} as bucket, matched from modes where mode = 'pp_full' and not is_dropped) select run_key, bucket, count(*) as n, count(*) filter (where matched) as tp from k group by 1, 2", fx=True)
def e10_mode_deciles(spark, d):
    kept = full_mode(tables(spark, d)[2])
    return kept.groupBy("run_key", C.decile_of(F.col("score_pp_full")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("matched").alias("tp"))


@query("i1_count_identity", f"with {sweep_sql('fx_scored', 'confidence', T.TENTHS)} select run_key, language, category, threshold from sweep where tp + fn <> n_gt_pos or fp + tn <> n_gt_neg", fx=True)
def i1_count_identity(spark, d):
    files, gt, flags = tables(spark, d)
    s = T.sweep(files, gt, flags, "confidence", T.TENTHS)
    return s.where("tp + fn <> n_gt_pos or fp + tn <> n_gt_neg").select("run_key", "language", "category", "threshold")


@query("i3_none_row_equals_confusion", "select run_key, true as equal from (select distinct run_key from fx_files)", fx=True)
def i3_none_row_equals_confusion(spark, d):
    """The row without threshold for ALL has the counts of the plain file-level table."""
    files, gt, flags = tables(spark, d)
    s = T.sweep(files, gt, flags, "confidence", [0.5], keys=("run_key",), all_keys=()).where("category = 'ALL' and threshold is null").select("run_key", "tp", "fp", "fn", "tn")
    p = C.file_level(C.per_file(files, gt, flags), "run_key").select("run_key", *[F.col(c).alias(f"p_{c}") for c in ("tp", "fp", "fn", "tn")])
    return s.join(p, "run_key").select("run_key", ((F.col("tp") == F.col("p_tp")) & (F.col("fp") == F.col("p_fp")) & (F.col("fn") == F.col("p_fn")) & (F.col("tn") == F.col("p_tn"))).alias("equal"))


def at_all(spark, d, files, flags, score, threshold):
    s = T.sweep(files, tables(spark, d)[1], flags, score, [threshold], keys=("run_key",), all_keys=())
    return s.where(f"category = 'ALL' and threshold = {threshold}D")


#: run -> scoring mode and threshold that were picked for it on the development set
PICKED = {"m1": ("sa", 0.6), "m3": ("pp_full", 0.9)}
HELD = "held as (select * from fx_files where user_id % 8 <> 0)"
ALL_AT = "{n} as (select run_key, recall, specificity, n_gt_pos, n_gt_neg from (with {sweep} select * from sweep) where language = 'ALL' and category = 'ALL' and threshold = {t})"


@query("a29_heldout_leaderboard", f"""with {MODES}, {HELD}, mr as (select * exclude (score), score as s from modes where mode = 'raw'), mp as (select * exclude (score), score as s from modes where mode = 'pp_full' and not is_dropped), ms as (select * exclude (score), score as s from modes where mode = 'sa'),
{ALL_AT.format(n='raw8', sweep=sweep_sql('mr', 's', [0.8], files='held'), t=0.8)}, {ALL_AT.format(n='pp8', sweep=sweep_sql('mp', 's', [0.8], files='held'), t=0.8)}, {ALL_AT.format(n='sa6', sweep=sweep_sql('ms', 's', [0.6], files='held'), t=0.6)}, {ALL_AT.format(n='pp9', sweep=sweep_sql('mp', 's', [0.9], files='held'), t=0.9)},
l as (select r.run_key, r.n_gt_pos + r.n_gt_neg as heldout_files, r.run_key <> 'm2' as complete, r.n_gt_pos as gt_pos_files, r.n_gt_neg as gt_neg_files, r.recall as raw08_recall, r.specificity as raw08_spec, case when r.run_key <> 'm1' then p.recall end as pp08_recall, case when r.run_key <> 'm1' then p.specificity end as pp08_spec,
 case r.run_key when 'm1' then 'sa @ 0.6' when 'm3' then 'pp_full @ 0.9' end as picked, case r.run_key when 'm1' then s.recall when 'm3' then q.recall end as picked_recall, case r.run_key when 'm1' then s.specificity when 'm3' then q.specificity end as picked_spec
 from raw8 r join pp8 p using (run_key) join sa6 s using (run_key) join pp9 q using (run_key))
select *, row_number() over (order by complete desc, coalesce(raw08_recall, 0) + coalesce(raw08_spec, 0) desc, run_key) as place from l""", fx=True)
def a29_heldout_leaderboard(spark, d):
    """Held-out files only: the raw setting, the post-processed one where the prompt has its fields, and the one picked for the run; complete runs first."""
    files, gt, flags = tables(spark, d)
    held = files.join(files.where("user_id % 8 = 0").select("file_id").distinct(), "file_id", "left_anti")
    scored = S.with_modes(flags)
    kept = lambda mode: scored.where("not dropped") if mode in S.MODES[2:] else scored
    rates = lambda mode, t, name: at_all(spark, d, held, kept(mode), f"score_{mode}", t).select("run_key", F.col("recall").alias(f"{name}_recall"), F.col("specificity").alias(f"{name}_spec"))
    raw = at_all(spark, d, held, scored, "score_raw", 0.8).select("run_key", (F.col("n_gt_pos") + F.col("n_gt_neg")).alias("heldout_files"), F.col("n_gt_pos").alias("gt_pos_files"), F.col("n_gt_neg").alias("gt_neg_files"), F.col("recall").alias("raw08_recall"), F.col("specificity").alias("raw08_spec"))
    pp = rates("pp_full", 0.8, "pp08").where("run_key <> 'm1'")  # the prompt of m1 has none of the fields
    picked = None
    for run, (mode, t) in PICKED.items():
        one = rates(mode, t, "picked").where(F.col("run_key") == run).withColumn("picked", F.lit(f"{mode} @ {t}"))
        picked = one if picked is None else picked.unionByName(one)
    rows = raw.withColumn("complete", F.col("run_key") != "m2").join(pp, "run_key", "left").join(picked, "run_key", "left")
    return rows.withColumn("place", heldout_place())


def heldout_place():
    """Complete runs first, then by recall plus specificity; one row a run."""
    total = F.coalesce("raw08_recall", F.lit(0.0)) + F.coalesce("raw08_spec", F.lit(0.0))
    return F.row_number().over(W.orderBy(F.col("complete").desc(), total.desc(), "run_key"))


@query("r7_heldout_order", f"with {sweep_sql('fx_scored', 'confidence', [0.8], keys='run_key, language')}, s as (select run_key || ' ' || language as run_key, language <> 'tamil' and run_key <> 'm2' as complete, case when language <> 'kannada' then recall end as raw08_recall, specificity as raw08_spec from sweep where category = 'ALL' and threshold = 0.8 and language <> 'ALL') select *, row_number() over (order by complete desc, coalesce(raw08_recall, 0) + coalesce(raw08_spec, 0) desc, run_key) as place from s", fx=True)
def r7_heldout_order(spark, d):
    """Runs by language in the order of the held-out report: complete ones first, then recall plus specificity, of which either may be missing."""
    files, gt, flags = tables(spark, d)
    s = T.sweep(files, gt, flags, "confidence", [0.8], keys=("run_key", "language"), all_keys=()).where("category = 'ALL' and threshold = 0.8D")
    rows = s.select(F.concat_ws(" ", "run_key", "language").alias("run_key"), F.expr("language <> 'tamil' and run_key <> 'm2'").alias("complete"), F.when(F.col("language") != "kannada", F.col("recall")).alias("raw08_recall"), F.col("specificity").alias("raw08_spec"))
    return rows.withColumn("place", heldout_place())


@query("r6_leaderboard_rank", f"with {sweep_sql('fx_scored', 'confidence', [0.8])}, s as (select run_key, (recall + specificity) / 2 as balanced_acc from sweep where language = 'ALL' and category = 'ALL' and threshold = 0.8) select run_key, balanced_acc, row_number() over (order by coalesce(balanced_acc, 0) desc, run_key) as place from s", fx=True)
def r6_leaderboard_rank(spark, d):
    files, _, flags = tables(spark, d)
    s = at_all(spark, d, files, flags, "confidence", 0.8).select("run_key", ((F.col("recall") + F.col("specificity")) / 2).alias("balanced_acc"))
    return s.withColumn("place", F.row_number().over(W.orderBy(F.coalesce("balanced_acc", F.lit(0.0)).desc(), "run_key")))  # one row a run


@query("v6_overview_matrix", f"with {sweep_sql('fx_scored', 'confidence', [0.8])}, c as (select run_key, category, tp || '/' || (tp + fn) || ' ' || tn || '/' || (tn + fp) as cell from sweep where language = 'ALL' and threshold = 0.8) select category, " + ", ".join(f"max(cell) filter (where run_key = '{r}') as {r}" for r in X.RUNS) + " from c group by 1", fx=True)
def v6_overview_matrix(spark, d):
    """Recall and specificity as counts, a column a run of the table."""
    files, gt, flags = tables(spark, d)
    s = T.sweep(files, gt, flags, "confidence", [0.8], keys=("run_key",), all_keys=()).where("threshold = 0.8D")
    cell = F.concat("tp", F.lit("/"), F.col("tp") + F.col("fn"), F.lit(" "), "tn", F.lit("/"), F.col("tn") + F.col("fp"))
    runs = sorted(r["run_key"] for r in files.select("run_key").distinct().collect())  # one name a run
    return s.withColumn("cell", cell).groupBy("category").pivot("run_key", runs).agg(F.max("cell"))


REPORT = [("Files by run", ["run_key", "tp", "fp", "fn", "tn"]), ("Files by run and language", ["run_key", "language", "tp", "fp", "fn", "tn"])]
REPORT_COUNTS = ", ".join(f"count(*) filter (where file_bucket = '{b}') as {b.lower()}" for b in ("TP", "FP", "FN", "TN"))


def report_sql():
    parts = []
    for k, (title, columns) in enumerate(REPORT, 1):
        keys = ", ".join(columns[:-4])
        line = " || ' | ' || ".join(columns)
        head = [f"## {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]
        parts += [f"select {k} as section, {i} as line, '{text}' as text" for i, text in enumerate(head, 1)]
        parts.append(f"select {k}, 4 + row_number() over (order by {keys}), '| ' || {line} || ' |' from (select {keys}, {REPORT_COUNTS} from pf group by {keys})")
    return f"with {FILE_STATE} " + " union all ".join(parts)


@query("io18_markdown_report", report_sql(), fx=True)
def io18_markdown_report(spark, d):
    """Two tables as the lines of one markdown report."""
    per_file = C.per_file(*tables(spark, d))
    counts = [F.count_if(F.col("file_bucket") == b).alias(b.lower()) for b in ("TP", "FP", "FN", "TN")]
    return io.report_lines([(title, per_file.groupBy(*columns[:-4]).agg(*counts), columns[:-4]) for title, columns in REPORT])
