"""Confusion, bucket and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import confusion as C
from ..operators import ranking as R
from ..operators import scoring as S
from ..operators.ordered import running_sums
from ..sources import fixtures as X
from .base import query

FILE_STATE = """
st as (select f.run_key, f.file_id, f.language, coalesce(g.n, 0) as n_gt, coalesce(m.n, 0) as n_flags, coalesce(m.tp, 0) as flag_tp, coalesce(m.red, 0) as flag_redundant
  from fx_files f left join (select file_id, count(*) as n from fx_gt group by 1) g using (file_id)
  left join (select run_key, file_id, count(*) as n, count(*) filter (where matched) as tp, count(*) filter (where fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE') as red from fx_scored group by 1, 2) m using (run_key, file_id)),
pf as (select *, n_flags - flag_tp as flag_fp, n_gt - flag_tp as flag_fn,
  case when n_gt > 0 and flag_tp > 0 then 'TP' when n_gt > 0 then 'FN' when n_flags > 0 then 'FP' else 'TN' end as file_bucket from st)
"""
RATIOS = "tp / nullif(tp + fp, 0)::double as precision, tp / nullif(tp + fn, 0)::double as recall, tn / nullif(tn + fp, 0)::double as specificity, (tp + tn) / nullif(tp + fp + fn + tn, 0)::double as accuracy"
COUNTS4 = ", ".join(f"count(*) filter (where file_bucket = '{b}') as {b.lower()}" for b in ("TP", "FP", "FN", "TN"))


def tables(spark, d):
    return X.staged_tables(spark, d)


def scored(spark, d):
    return C.per_file(*tables(spark, d))


@query("a2_file_confusion", f"with {FILE_STATE}, c as (select run_key, {COUNTS4} from pf group by 1) select run_key, tp, fp, fn, tn, {RATIOS} from c", fx=True)
def a2_file_confusion(spark, d):
    return C.file_level(scored(spark, d), "run_key")


@query("a2_file_buckets", f"with {FILE_STATE} select run_key, file_id, n_gt, n_flags, flag_tp, flag_fp, flag_fn, file_bucket from pf", fx=True)
def a2_file_buckets(spark, d):
    return scored(spark, d).select("run_key", "file_id", "n_gt", "n_flags", "flag_tp", "flag_fp", "flag_fn", "file_bucket")


@query("a4_file_level_by_language", f"with {FILE_STATE}, l as (select run_key, language, file_bucket from pf union all select run_key, 'ALL', file_bucket from pf), c as (select run_key, language, {COUNTS4} from l group by 1, 2) select run_key, language, tp, fp, fn, tn, {RATIOS} from c", fx=True)
def a4_file_level_by_language(spark, d):
    return C.file_level(C.with_all(scored(spark, d), "language"), "run_key", "language")


FLAG_SUMS = "sum(flag_tp) as tp, sum(flag_fp) - sum(flag_redundant) as fp, sum(flag_fn) as fn, count(*) filter (where n_gt = 0 and n_flags = 0) as tn, sum(flag_redundant) as redundant"
FLAG_RATIOS = RATIOS.replace("tp / nullif(tp + fp, 0)::double as precision", "(tp + redundant) / nullif(tp + redundant + fp, 0)::double as precision")


@query("a5_flag_level", f"with {FILE_STATE}, l as (select * from pf union all select * replace ('ALL' as language) from pf), c as (select run_key, language, {FLAG_SUMS} from l group by 1, 2) select run_key, language, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn, redundant::bigint as redundant, {FLAG_RATIOS} from c", fx=True)
def a5_flag_level(spark, d):
    return C.flag_level(C.with_all(scored(spark, d), "language"), "run_key", "language")


PP = """
pp as (select *, category not in ('PlatformMove', 'SuspiciousActivity', 'Explicit-Flirting') as pp_dropped,
  coalesce(confidence, 0) as c0, coalesce(speech_act in ('reported', 'denial'), false) as act, coalesce(violation = 'no', false) as vio from fx_scored),
p2 as (select *, case when act then least(c0, 0.3) else c0 end as c1 from pp),
p3 as (select *, case when vio then least(c1, 0.3) else c1 end as pp_confidence,
  list_filter([case when pp_dropped then 'category_drop' end, case when act and c0 > 0.3 then 'speech_act_cap' end, case when vio and c1 > 0.3 then 'violation_cap' end], lambda x: x is not null) as rules from p2)
"""


@query("p3_post_processing", f"with {PP} select event_id, pp_confidence, pp_dropped, array_to_string(rules, ',') as rules from p3", fx=True)
def p3_post_processing(spark, d):
    return S.post_process(tables(spark, d)[2], "pp_v1").select("event_id", "pp_confidence", "pp_dropped", F.array_join("pp_rules", ",").alias("rules"))


@query("p3_post_processing_noviol", f"with {PP} select event_id, c1 as pp_confidence, pp_dropped, array_to_string(list_filter(rules, lambda x: x <> 'violation_cap'), ',') as rules from p3", fx=True)
def p3_post_processing_noviol(spark, d):
    return S.post_process(tables(spark, d)[2], "pp_v1_noviol").select("event_id", "pp_confidence", "pp_dropped", F.array_join("pp_rules", ",").alias("rules"))


MODES = """
md0 as (select *, coalesce(confidence, 0) as c0, category not in ('PlatformMove', 'SuspiciousActivity', 'Explicit-Flirting') as bad from fx_scored),
md1 as (select *, case when prompt in ('v4', 'v6') and (speech_act is null or speech_act in ('reported', 'denial')) then least(c0, 0.3) else c0 end as c1 from md0),
md2 as (select *, case when prompt = 'v6' and speaker = 'unclear' then least(c1, 0.3) else c1 end as sa from md1),
md3 as (select *, case when prompt in ('v4', 'v6') and violation = 'no' then least(sa, 0.3) else sa end as full_ from md2),
modes as (select *, 'raw' as mode, confidence as score, false as is_dropped from md3 union all select *, 'sa', sa, false from md3
  union all select *, 'sa_drop_invalid', sa, bad from md3 union all select *, 'pp_full', full_, bad from md3)
"""


@query("p2_scoring_modes", f"with {MODES} select event_id, mode, score, is_dropped from modes", fx=True)
def p2_scoring_modes(spark, d):
    return S.by_mode(tables(spark, d)[2]).select("event_id", "mode", "score", "is_dropped")


@query("p1_threshold_predicate", "select event_id, coalesce(confidence >= 0.5, false) as passes_half, true as passes_none from fx_scored", fx=True)
def p1_threshold_predicate(spark, d):
    c = F.col("confidence")
    return tables(spark, d)[2].select("event_id", S.passes(c, F.lit(0.5)).alias("passes_half"), S.passes(c, F.lit(None).cast("double")).alias("passes_none"))


@query("p4_mode_rows", f"with {MODES} select f.run_key, m.mode, f.file_id, count(k.event_id) as n_kept from fx_files f cross join (values ('raw'), ('sa'), ('sa_drop_invalid'), ('pp_full')) m(mode) left join modes k on k.run_key = f.run_key and k.file_id = f.file_id and k.mode = m.mode and not k.is_dropped group by 1, 2, 3", fx=True)
def p4_mode_rows(spark, d):
    files, _, flags = tables(spark, d)
    kept = S.by_mode(flags).where("not is_dropped").groupBy("run_key", "mode", "file_id").agg(F.count("*").alias("n_kept"))
    grid = files.select("run_key", "file_id", F.explode(F.array(*map(F.lit, S.MODES))).alias("mode"))
    return grid.join(kept, ["run_key", "mode", "file_id"], "left").select("run_key", "mode", "file_id", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("p5_category_scope", "select f.run_key, f.file_id, count(distinct g.event_id) as n_gt, count(distinct s.event_id) as n_flags from fx_files f left join fx_gt g on g.file_id = f.file_id and g.category = 'PlatformMove' left join fx_scored s on s.run_key = f.run_key and s.file_id = f.file_id and s.category = 'PlatformMove' group by 1, 2", fx=True)
def p5_category_scope(spark, d):
    files, gt, flags = tables(spark, d)
    only = F.col("category") == "PlatformMove"
    return C.per_file(files, gt.where(only), flags.where(only)).select("run_key", "file_id", "n_gt", "n_flags")


@query("p6_redundant_flags", "select event_id, coalesce(fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE', false) as redundant from fx_scored", fx=True)
def p6_redundant_flags(spark, d):
    return tables(spark, d)[2].select("event_id", S.redundant().alias("redundant"))


@query("p8_candidates", f"with {MODES} select event_id, score from modes where mode = 'pp_full' and score >= 0.3 and not bad", fx=True)
def p8_candidates(spark, d):
    return S.with_modes(tables(spark, d)[2]).where(~F.col("dropped") & (F.col("score_pp_full") >= 0.3)).select("event_id", F.col("score_pp_full").alias("score"))


@query("p9_composite_score", "select event_id, coalesce(confidence, 0) * coalesce(logprob_confidence, 0) * (1 - coalesce(case when event_id % 5 > 0 then (event_id % 7) / 7.0 end, 0)) * coalesce((event_id % 3) / 3.0, 0) as score from fx_scored", fx=True)
def p9_composite_score(spark, d):
    parts = F.col("confidence"), F.col("logprob_confidence"), F.expr("case when event_id % 5 > 0 then (event_id % 7) / 7.0D end"), F.expr("(event_id % 3) / 3.0D")
    return tables(spark, d)[2].select("event_id", S.composite(*parts).alias("score"))


@query("a6_file_level_pp", f"""with {PP}, st as (select f.run_key, f.file_id, exists (select 1 from fx_gt g where g.file_id = f.file_id) as pos,
  exists (select 1 from p3 where p3.run_key = f.run_key and p3.file_id = f.file_id and not pp_dropped and matched) as hit, exists (select 1 from p3 where p3.run_key = f.run_key and p3.file_id = f.file_id and not pp_dropped) as any_ from fx_files f),
c as (select run_key, count(*) filter (where pos and hit) as tp, count(*) filter (where not pos and any_) as fp, count(*) filter (where pos and not hit) as fn, count(*) filter (where not pos and not any_) as tn from st group by 1)
select run_key, tp, fp, fn, tn, {RATIOS} from c""", fx=True)
def a6_file_level_pp(spark, d):
    files, gt, flags = tables(spark, d)
    return C.file_level(C.per_file(files, gt, S.post_process(flags, "pp_v1").where("not pp_dropped")), "run_key")


@query("a7_flag_level_pp", f"""with {PP}, st as (select f.run_key, f.file_id, (select count(*) from fx_gt g where g.file_id = f.file_id) as n_gt,
  (select count(*) from p3 where p3.run_key = f.run_key and p3.file_id = f.file_id and not pp_dropped) as n_flags, (select count(*) from p3 where p3.run_key = f.run_key and p3.file_id = f.file_id and not pp_dropped and matched) as flag_tp,
  (select count(*) from p3 where p3.run_key = f.run_key and p3.file_id = f.file_id and not pp_dropped and fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE') as flag_redundant from fx_files f),
pf as (select *, n_flags - flag_tp as flag_fp, n_gt - flag_tp as flag_fn from st), c as (select run_key, {FLAG_SUMS} from pf group by 1)
select run_key, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn, redundant::bigint as redundant, {FLAG_RATIOS} from c""", fx=True)
def a7_flag_level_pp(spark, d):
    files, gt, flags = tables(spark, d)
    return C.flag_level(C.per_file(files, gt, S.post_process(flags, "pp_v1").where("not pp_dropped")), "run_key")


@query("a8_pp_report", f"with {PP} select run_key, count(*) as n_flags, count(*) filter (where pp_dropped) as n_dropped, count(*) filter (where matched and list_contains(rules, 'speech_act_cap')) as tp_capped_by_speech_act from p3 group by 1", fx=True)
def a8_pp_report(spark, d):
    p = S.post_process(tables(spark, d)[2], "pp_v1")
    return p.groupBy("run_key").agg(F.count("*").alias("n_flags"), F.count_if("pp_dropped").alias("n_dropped"), F.count_if(F.col("matched") & F.array_contains("pp_rules", "speech_act_cap")).alias("tp_capped_by_speech_act"))


BINS = "bins(bucket, lo, hi) as (values ('0.0-0.2', 0.0, 0.2), ('0.2-0.4', 0.2, 0.4), ('0.4-0.6', 0.4, 0.6), ('0.6-0.8', 0.6, 0.8), ('0.8-1.0', 0.8, 1.0001))"


@query("a9_confidence_buckets", f"""with {BINS}, g as (select run_key, bucket, lo::double as lo, hi::double as hi from (select distinct run_key from fx_scored), bins)
select g.run_key, bucket, count(event_id) as n_flags, count(event_id) filter (where matched) as tp, count(event_id) filter (where not matched) as fp, count(event_id) filter (where matched) / nullif(count(event_id), 0)::double as precision,
  avg(entropy_mean) as mean_entropy, avg(entropy_mean) filter (where matched) as mean_entropy_tp, avg(entropy_mean) filter (where not matched) as mean_entropy_fp
from g left join fx_scored s on s.run_key = g.run_key and confidence >= lo and confidence < hi group by 1, 2""", fx=True)
def a9_confidence_buckets(spark, d):
    return C.bin_table(tables(spark, d)[2], C.five_bins(spark), "confidence")


@query("a10_entropy_by_correctness", "select run_key, avg(entropy_mean) as mean_all, count(entropy_mean) as n_all, avg(entropy_mean) filter (where matched) as mean_tp, count(entropy_mean) filter (where matched) as n_tp, avg(entropy_mean) filter (where not matched) as mean_fp, count(entropy_mean) filter (where not matched) as n_fp from fx_scored group by 1", fx=True)
def a10_entropy_by_correctness(spark, d):
    e, m = F.col("entropy_mean"), F.col("matched")
    return tables(spark, d)[2].groupBy("run_key").agg(F.avg(e).alias("mean_all"), F.count(e).alias("n_all"), F.avg(F.when(m, e)).alias("mean_tp"), F.count(F.when(m, e)).alias("n_tp"), F.avg(F.when(~m, e)).alias("mean_fp"), F.count(F.when(~m, e)).alias("n_fp"))


@query("a11_tp_rate_by_label", "select run_key, coalesce(speech_act, '(missing)') as label, count(*) as n, count(*) filter (where matched) as tp, avg(case when matched then 1.0 else 0.0 end) as tp_rate from fx_scored group by 1, 2", fx=True)
def a11_tp_rate_by_label(spark, d):
    label = F.coalesce("speech_act", F.lit("(missing)")).alias("label")
    return tables(spark, d)[2].groupBy("run_key", label).agg(F.count("*").alias("n"), F.count_if("matched").alias("tp"), F.avg(F.col("matched").cast("double")).alias("tp_rate"))


@query("a12_violation_by_matched", "select run_key, coalesce(violation, '(missing)') as violation, matched, count(*) as n from fx_scored group by 1, 2, 3", fx=True)
def a12_violation_by_matched(spark, d):
    return tables(spark, d)[2].groupBy("run_key", F.coalesce("violation", F.lit("(missing)")).alias("violation"), "matched").agg(F.count("*").alias("n"))


def matched_index(flags, gt):
    """(run_key, file_id, gt_index) of the reference flags that a run caught."""
    return flags.where("matched").select("run_key", "file_id", F.col("matched_gi").alias("gt_index"))


HITS = "hits as (select run_key, file_id, matched_gi as gt_index from fx_scored where matched)"


@query("a3_qualifying_bucket", f"""with {FILE_STATE}, {HITS}, q as (select pf.run_key, pf.file_id, pf.file_bucket, count(w.event_id) as n_wanted, count(h.gt_index) as n_hit
from pf left join fx_gt w on w.file_id = pf.file_id and w.category in ('PlatformMove', 'Explicit-Flirting') and coalesce(w.confidence, 0) >= 0.8 left join hits h on h.run_key = pf.run_key and h.gt_index = w.event_id group by 1, 2, 3)
select run_key, file_id, file_bucket, case when n_wanted > 0 and n_wanted = n_hit then 'TP' else file_bucket end as qualifying_bucket from q""", fx=True)
def a3_qualifying_bucket(spark, d):
    files, gt, flags = tables(spark, d)
    found = C.qualifying_bucket(C.per_file(files, gt, flags), gt.withColumn("gt_index", F.col("event_id")), matched_index(flags, gt))
    return found.select("run_key", "file_id", "file_bucket", "qualifying_bucket")


@query("e5_matched_gt_sets", f"with {HITS} select run_key, file_id, array_to_string(list_transform(list_sort(list(gt_index)), lambda x: x::varchar), ';') as gt_indices from hits group by 1, 2", fx=True)
def e5_matched_gt_sets(spark, d):
    _, gt, flags = tables(spark, d)
    return matched_index(flags, gt).groupBy("run_key", "file_id").agg(F.array_join(F.array_sort(F.collect_set("gt_index")).cast("array<string>"), ";").alias("gt_indices"))


@query("a18_confidence_values", "select run_key, matched, round(confidence, 3) as value, count(*) as n from fx_scored group by 1, 2, 3", fx=True)
def a18_confidence_values(spark, d):
    return tables(spark, d)[2].groupBy("run_key", "matched", F.round("confidence", 3).alias("value")).agg(F.count("*").alias("n"))


@query("a19_preflight", "select run_key, count(*) as n, avg(case when confidence is null then 1.0 else 0.0 end) as missing_confidence, avg(case when speech_act is null then 1.0 else 0.0 end) as missing_speech_act, avg(case when violation is null then 1.0 else 0.0 end) as missing_violation, count(*) filter (where category not in ('PlatformMove', 'SuspiciousActivity', 'Explicit-Flirting')) as invalid_category from fx_scored group by 1", fx=True)
def a19_preflight(spark, d):
    miss = lambda c: F.avg(F.col(c).isNull().cast("double"))
    return tables(spark, d)[2].groupBy("run_key").agg(F.count("*").alias("n"), miss("confidence").alias("missing_confidence"), miss("speech_act").alias("missing_speech_act"), miss("violation").alias("missing_violation"), F.count_if(~S.valid_category(F.col("category"))).alias("invalid_category"))


@query("a20_error_file_ids", f"with {FILE_STATE} select run_key, file_bucket, string_agg(file_id, ';' order by file_id) as file_ids from pf where file_bucket in ('FP', 'FN') group by 1, 2", fx=True)
def a20_error_file_ids(spark, d):
    wrong = scored(spark, d).where(F.col("file_bucket").isin("FP", "FN"))
    return wrong.groupBy("run_key", "file_bucket").agg(F.array_join(F.array_sort(F.collect_list("file_id")), ";").alias("file_ids"))


@query("a20_error_file_rows", f"with {FILE_STATE} select run_key, file_bucket, row_number() over (partition by run_key, file_bucket order by file_id) as place, file_id from pf where file_bucket in ('FP', 'FN')", fx=True)
def a20_error_file_rows(spark, d):
    """The same files as rows with their places, for lists of any length; only a sink joins them to one text."""
    wrong = scored(spark, d).where(F.col("file_bucket").isin("FP", "FN")).select("run_key", "file_bucket", "file_id", F.lit(1).cast("long").alias("one"))
    placed = running_sums(wrong, ["run_key", "file_bucket"], [F.col("file_id").asc()], ["one"])
    return placed.select("run_key", "file_bucket", F.col("upto_one").alias("place"), "file_id")


@query("a21_flags_at_threshold", "select run_key, count(*) filter (where confidence >= 0.8) as n_at_08, count(*) filter (where confidence >= 0.9) as n_at_09 from fx_scored group by 1", fx=True)
def a21_flags_at_threshold(spark, d):
    return tables(spark, d)[2].groupBy("run_key").agg(F.count_if(F.col("confidence") >= 0.8).alias("n_at_08"), F.count_if(F.col("confidence") >= 0.9).alias("n_at_09"))


DECILE = "case when {c} is null then 'missing' " + " ".join(f"when {{c}} >= {i / 10} and {{c}} {'<=' if i == 9 else '<'} {(i + 1) / 10} then '{i / 10:.1f}-{(i + 1) / 10:.1f}'" for i in range(10)) + " else 'out_of_range' end"
CATS = "(values ('PlatformMove'), ('SuspiciousActivity'), ('Explicit-Flirting'), ('ALL')) c(cat)"
LABELS = ", ".join(f"('{x}')" for x in C.DECILES)


@query("a22_decile_buckets", f"""with own as (select run_key, cat, {DECILE.format(c='confidence')} as bucket, matched, coalesce(fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE', false) as red from fx_scored, {CATS} where cat = 'ALL' or cat = category),
n as (select run_key, cat, bucket, count(*) as n_flags, count(*) filter (where matched) as tp, count(*) filter (where red) as redundant from own group by 1, 2, 3),
grid as (select run_key, cat, bucket from (select distinct run_key from fx_scored) r, {CATS}, (values {LABELS}) l(bucket) union select run_key, cat, bucket from n),
gt as (select cat, count(*) as n_gt_flags from fx_gt, {CATS} where cat = 'ALL' or cat = category group by 1)
select run_key, cat as category, bucket, coalesce(n_gt_flags, 0) as n_gt_flags, coalesce(n_flags, 0) as n_flags, coalesce(tp, 0) as tp, coalesce(redundant, 0) as redundant, coalesce(n_flags - tp - redundant, 0) as fp, (tp + redundant) / nullif(n_flags, 0)::double as precision
from grid left join n using (run_key, cat, bucket) left join gt using (cat)""", fx=True)
def a22_decile_buckets(spark, d):
    _, gt, flags = tables(spark, d)
    own = C.category_rows(flags, "category", "cat")
    n = own.groupBy("run_key", "cat", C.decile_of(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n_flags"), F.count_if("matched").alias("tp"), F.count_if(S.redundant()).alias("redundant"))
    cats, labels = F.explode(F.array(*map(F.lit, [*S.CATEGORIES, "ALL"]))), F.array(*map(F.lit, C.DECILES))
    grid = flags.select("run_key").distinct().select("run_key", cats.alias("cat")).select("run_key", "cat", F.explode(labels).alias("bucket"))
    grid = grid.union(n.select("run_key", "cat", "bucket")).distinct()
    g = C.category_rows(gt, "category", "cat").groupBy("cat").agg(F.count("*").alias("n_gt_flags"))
    out = grid.join(n, ["run_key", "cat", "bucket"], "left").join(F.broadcast(g), "cat", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    fp = F.coalesce(F.col("n_flags") - F.col("tp") - F.col("redundant"), F.lit(0)).alias("fp")
    return out.select("run_key", F.col("cat").alias("category"), "bucket", zero("n_gt_flags"), zero("n_flags"), zero("tp"), zero("redundant"), fp, C.ratio(F.col("tp") + F.col("redundant"), F.col("n_flags")).alias("precision"))


@query("a23_file_buckets_by_confidence", f"""with fc as (select run_key, file_id, cat, exists (select 1 from fx_gt g where g.file_id = f.file_id and (cat = 'ALL' or g.category = cat)) as pos from fx_files f, {CATS}),
mx as (select fc.run_key, fc.file_id, fc.cat, pos, count(s.event_id) as n, max(confidence) as c from fc left join fx_scored s on s.run_key = fc.run_key and s.file_id = fc.file_id and case when pos then matched and (cat = 'ALL' or matched_gt_category = cat) else (cat = 'ALL' or category = cat) end group by 1, 2, 3, 4),
b as (select run_key, cat, pos, case when n = 0 then 'none' else {DECILE.format(c='c')} end as bucket from mx)
select run_key, cat as category, bucket, count(*) filter (where pos) as pos_files, count(*) filter (where not pos) as neg_files from b group by 1, 2, 3""", fx=True)
def a23_file_buckets_by_confidence(spark, d):
    """Files by the bucket of their highest deciding flag; 'none' holds never-caught and never-flagged files."""
    files, gt, flags = tables(spark, d)
    cats = F.explode(F.array(*map(F.lit, [*S.CATEGORIES, "ALL"]))).alias("cat")
    pos = C.category_rows(gt, "category", "cat").select("file_id", "cat").distinct().withColumn("pos", F.lit(True))
    caught = C.category_rows(flags.where("matched"), "matched_gt_category", "cat").groupBy("run_key", "file_id", "cat").agg(F.max("confidence").alias("hit"), F.count("*").alias("n_hit"))
    own = C.category_rows(flags, "category", "cat").groupBy("run_key", "file_id", "cat").agg(F.max("confidence").alias("any"), F.count("*").alias("n_any"))
    keys = ["run_key", "file_id", "cat"]
    state = files.select("run_key", "file_id", cats).join(pos, ["file_id", "cat"], "left").join(caught, keys, "left").join(own, keys, "left").withColumn("pos", F.coalesce("pos", F.lit(False)))
    n, best = F.when(F.col("pos"), F.col("n_hit")).otherwise(F.col("n_any")), F.when(F.col("pos"), F.col("hit")).otherwise(F.col("any"))
    bucket = F.when(F.coalesce(n, F.lit(0)) == 0, "none").otherwise(C.decile_of(best)).alias("bucket")
    return state.groupBy("run_key", F.col("cat").alias("category"), bucket).agg(F.count_if("pos").alias("pos_files"), F.count_if(~F.col("pos")).alias("neg_files"))


RATE = "cast(printf('%.2f', count(*) filter (where matched) / count(*)::double) as varchar)"


def _auroc_sql(name: str, rows: str) -> str:
    """Rank form of the AUROC of each run and mode over rows (run_key, mode, sig, matched)."""
    return f"""{name} as (select run_key, mode, (sum(rk) filter (where matched) - count(*) filter (where matched) * (count(*) filter (where matched) + 1) / 2.0) / nullif(count(*) filter (where matched)::double * count(*) filter (where not matched), 0) as auroc from
 (select *, rank() over (partition by run_key, mode order by sig) + (count(*) over (partition by run_key, mode, sig) - 1) / 2.0 as rk from {rows}) group by 1, 2)"""


@query("a17_mode_diagnostics", f"""with {MODES}, m as (select *, coalesce(score, 0) as sig, score < confidence as lower_ from modes), k as (select * from m where not is_dropped), z as (select * replace (case when is_dropped then -1.0 else sig end as sig) from m), {_auroc_sql('au', 'k')}, {_auroc_sql('az', 'z')},
s as (select run_key, mode, count(*) as n, count(*) filter (where is_dropped) as n_dropped, count(*) filter (where is_dropped and matched) as n_dropped_tp, count(*) filter (where not is_dropped and lower_) as n_capped, count(*) filter (where not is_dropped and lower_ and matched) as n_capped_tp,
 count(*) filter (where not is_dropped and matched and confidence >= 0.6 and score < 0.6) as below_06, count(*) filter (where not is_dropped and matched and confidence >= 0.8 and score < 0.8) as below_08 from m group by 1, 2),
ra as (select run_key, mode, string_agg(act || '=' || r, ',' order by act) as by_act from (select run_key, mode, coalesce(speech_act, '(missing)') as act, {RATE} as r from k where mode in ('sa', 'pp_full') group by 1, 2, 3) group by 1, 2),
rs as (select run_key, mode, string_agg(spk || '=' || r, ',' order by spk) as by_speaker from (select run_key, mode, coalesce(speaker, '(missing)') as spk, {RATE} as r from k where mode in ('sa', 'pp_full') group by 1, 2, 3) group by 1, 2)
select s.*, au.auroc, az.auroc as auroc_dropped_lowest, by_act, by_speaker from s join au using (run_key, mode) join az using (run_key, mode) left join ra using (run_key, mode) left join rs using (run_key, mode)""", fx=True)
def a17_mode_diagnostics(spark, d):
    """Per run and mode: what is dropped, capped and pushed below 0.6 and 0.8, the AUROC without and with dropped flags as lowest, and rates of true flags by act and speaker."""
    from ..functions.scalars import round_half_even

    m = S.by_mode(tables(spark, d)[2]).withColumn("sig", F.coalesce("score", F.lit(0.0)))
    kept, lower = ~F.col("is_dropped"), F.coalesce(F.col("score") < F.col("confidence"), F.lit(False))
    pushed = lambda t: F.count_if(kept & F.col("matched") & (F.col("confidence") >= t) & (F.col("score") < t))
    keys = ["run_key", "mode"]
    stats = m.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("is_dropped").alias("n_dropped"), F.count_if(F.col("is_dropped") & F.col("matched")).alias("n_dropped_tp"), F.count_if(kept & lower).alias("n_capped"),
        F.count_if(kept & lower & F.col("matched")).alias("n_capped_tp"), pushed(0.6).alias("below_06"), pushed(0.8).alias("below_08"),
    )
    au = R.auroc(m.where(kept), keys, "sig", F.col("matched")).select(*keys, "auroc")
    low = R.auroc(m.withColumn("sig", F.when(kept, F.col("sig")).otherwise(-1.0)), keys, "sig", F.col("matched")).select(*keys, F.col("auroc").alias("auroc_dropped_lowest"))

    def rates(column: str, name: str):
        rows = m.where(kept & F.col("mode").isin("sa", "pp_full")).groupBy(*keys, F.coalesce(column, F.lit("(missing)")).alias("v")).agg(F.avg(F.col("matched").cast("double")).alias("r"))
        shown = F.concat_ws("=", "v", F.format_string("%.2f", round_half_even(F.col("r"))))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", shown.alias("t")))), lambda x: x["t"]), ",").alias(name))

    return stats.join(au, keys).join(low, keys).join(rates("speech_act", "by_act"), keys, "left").join(rates("speaker", "by_speaker"), keys, "left")
