"""Rank statistics, log sessions and timing (R1-R13, A43, A47, I*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import timing as T
from ..sources import fixtures as X
from .base import query
from .confusion_queries import tables

LABELLED = "rk as (select d.doc_id, quality, toxic, n_chars::double as score from labels l join documents d using (doc_id) where quality is not null)"


def labelled(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return X.table(spark, d, "labels").where("quality is not null").join(docs, "doc_id").withColumn("one", F.lit(1))


@query("r1_auroc_documents", f"with {LABELLED}, r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from rk) select count(*) filter (where quality = 1) as n_pos, count(*) filter (where quality = 0) as n_neg, (sum(rk) filter (where quality = 1) - count(*) filter (where quality = 1) * (count(*) filter (where quality = 1) + 1) / 2.0) / nullif(count(*) filter (where quality = 1)::double * count(*) filter (where quality = 0), 0) as auroc from r")
def r1_auroc_documents(spark, d):
    return R.auroc(labelled(spark, d), ["one"], "score", F.col("quality") == 1).select("n_pos", "n_neg", "auroc")


@query("r1_auroc_runs", "with r as (select run_key, matched, rank() over (partition by run_key order by coalesce(confidence, -1)) + (count(*) over (partition by run_key, coalesce(confidence, -1)) - 1) / 2.0 as rk from fx_scored), s as (select run_key, sum(rk) filter (where matched) as rs, count(*) filter (where matched) as n_pos, count(*) filter (where not matched) as n_neg from r group by 1) select run_key, n_pos, n_neg, (rs - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos::double * n_neg, 0) as auroc from s", fx=True)
def r1_auroc_runs(spark, d):
    return R.auroc(tables(spark, d)[2], ["run_key"], "confidence", F.col("matched"))


CURVE = """
n_gt as (select r.run_key, (select count(*) from fx_gt) as n_gt from (select distinct run_key from fx_scored) r),
tg as (select run_key, confidence as s, count(*) as n, count(*) filter (where matched) as p from fx_scored group by 1, 2),
cv as (select *, sum(p) over w as tp, sum(n - p) over w as fp from tg join n_gt using (run_key) window w as (partition by run_key order by s desc nulls last))"""


def gt_totals(spark, d):
    _, gt, flags = tables(spark, d)
    return flags.select("run_key").distinct().crossJoin(F.broadcast(gt.agg(F.count("*").alias("n_gt"))))


@query("r3_auprc_tied", f"with {CURVE} select run_key, sum((p / n_gt::double) * (tp / (tp + fp)::double)) as auprc from cv group by 1", fx=True)
def r3_auprc_tied(spark, d):
    return R.auprc(tables(spark, d)[2], ["run_key"], "confidence", F.col("matched"), gt_totals(spark, d))


@query("r5_recall_at_fp_budget", f"with {CURVE} select run_key, " + ", ".join(f"case when max(n_gt) > 0 then coalesce(max(tp / n_gt::double) filter (where fp <= {b}), 0) end as recall_at_{b}_fp" for b in (10, 25, 50, 100)) + " from cv group by 1", fx=True)
def r5_recall_at_fp_budget(spark, d):
    return R.recall_at_fp(tables(spark, d)[2], ["run_key"], "confidence", F.col("matched"), gt_totals(spark, d), [10, 25, 50, 100])


@query("r4_average_precision", "with r as (select *, row_number() over w as i, sum(matched::int) over (partition by run_key order by confidence desc nulls last, event_id rows unbounded preceding) as h from fx_scored window w as (partition by run_key order by confidence desc nulls last, event_id)) select run_key, sum(h / i::double) filter (where matched) / count(*) filter (where matched) as average_precision from r group by 1", fx=True)
def r4_average_precision(spark, d):
    return R.average_precision(tables(spark, d)[2], ["run_key"], "confidence", F.col("matched"), "event_id")


@query("r9_group_share", "select run_key, fp_type, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by run_key) as pct from fx_scored where not matched and fp_type is not null group by 1, 2", fx=True)
def r9_group_share(spark, d):
    n = tables(spark, d)[2].where("not matched and fp_type is not null").groupBy("run_key", "fp_type").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("run_key")))


LOG = """
lg as (select user_id, event_id, ts, event_type, epoch_us(ts) / 1e6 as sec, value from events),
ses as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as run_no, lead(sec) over (partition by user_id order by ts, event_id) as next_sec, lead(event_type) over (partition by user_id order by ts, event_id) as next_type from lg),
calls as (select user_id, event_id, run_no, next_sec - sec as seconds, 1 + user_id % 300 as audio_sec, (next_sec - sec) / (1 + user_id % 300) as rtf, value > 400 as stall from ses where event_type <> 'signup' and run_no > 0 and next_sec is not null and next_type <> 'signup' and next_sec > sec)"""


@query("r10_log_sessions", f"with {LOG} select user_id, event_id, run_no::bigint as run_no, round(seconds, 6) as seconds from calls")
def r10_log_sessions(spark, d):
    return calls(spark, d).select("user_id", "event_id", "run_no", F.round("seconds", 6).alias("seconds"))


def calls(spark, d):
    events = X.table(spark, d, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) / 1e6D").alias("sec"), "event_type", "value")
    found = T.sessions(events, "user_id", F.col("event_type") == "signup")
    return found.withColumn("audio_sec", F.expr("1 + user_id % 300")).withColumns({"rtf": F.col("seconds") / F.col("audio_sec"), "stall": F.col("value") > 400})


@query("r11_rtf_outliers", f"with {LOG}, c as (select *, user_id % 4 as grp from calls where not stall), q as (select grp, count(*) as n, list_sort(list(rtf)) as r from c group by 1), k as (select grp, n, case when n >= 4 then r[n * 3 // 4 + 1] + 3 * (r[n * 3 // 4 + 1] - r[n // 4 + 1]) end as cut from q) select grp, count(*) as kept, n as clean, round(cut, 6) as cut from c join k using (grp) where cut is null or rtf <= cut group by grp, n, cut")
def r11_rtf_outliers(spark, d):
    clean = calls(spark, d).where("not stall").withColumn("grp", F.expr("user_id % 4"))
    return T.without_outliers(clean, "grp", "rtf").groupBy("grp", "n", "cut").agg(F.count("*").alias("kept")).select("grp", "kept", F.col("n").alias("clean"), F.round("cut", 6).alias("cut"))


@query("a43_rtf_summary", f"with {LOG} select user_id % 4 as grp, count(*) as n, round(avg(rtf), 6) as mean_rtf, round(median(rtf), 6) as median_rtf, round(sum(seconds) / sum(audio_sec), 6) as overall_rtf from calls where not stall group by 1")
def a43_rtf_summary(spark, d):
    c = calls(spark, d).where("not stall").withColumn("grp", F.expr("user_id % 4"))
    return T.rtf_summary(c, "grp")


@query("r13_segment_spans", "select conv_id, turn, (turn * 15)::double as start_s, coalesce(lead((turn * 15)::double) over (partition by conv_id order by turn), (15 * count(*) over (partition by conv_id) + 5)::double) as end_s from conversations")
def r13_segment_spans(spark, d):
    t = X.table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * F.lit(15.0)).alias("start_s"))
    return T.spans(t, "conv_id", "start_s", F.lit(15.0) * F.count("*").over(W.partitionBy("conv_id")) + 5).select("conv_id", "turn", "start_s", "end_s")


@query("a47_token_usage", "select event_type as modality, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as tokens, sum(value * 0.001) as cost from events group by 1")
def a47_token_usage(spark, d):
    e = X.table(spark, d, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy(F.col("event_type").alias("modality")).agg(F.count("*").alias("n"), F.sum("k").alias("tokens"), F.sum(F.col("value") * 0.001).alias("cost"))


@query("l1_sorted_ids", "select run_key, event_id, row_number() over (partition by run_key order by confidence desc nulls last, event_id) as place from fx_scored", fx=True)
def l1_sorted_ids(spark, d):
    return tables(spark, d)[2].select("run_key", "event_id", F.row_number().over(W.partitionBy("run_key").orderBy(F.desc_nulls_last("confidence"), "event_id")).alias("place"))


@query("l2_head", "select event_id, file_id from fx_base order by event_id limit 20", fx=True)
def l2_head(spark, d):
    return X.base(spark, d).select("event_id", "file_id").orderBy("event_id").limit(20)


@query("l3_bucket_sample", "with r as (select event_id, category, row_number() over (partition by category order by md5('7|' || event_id), event_id) as place from fx_base) select event_id, category from r where place <= 5", fx=True)
def l3_bucket_sample(spark, d):
    seeded = X.base(spark, d).withColumn("_o", F.md5(F.concat(F.lit("7|"), F.col("event_id").cast("string"))))
    w = W.partitionBy("category").orderBy("_o", "event_id")
    return seeded.withColumn("_i", F.row_number().over(w)).where("_i <= 5").select("event_id", "category")


@query("l4_review_sample", "with f as (select *, row_number() over (partition by run_key, fp_type order by md5('3|' || event_id), event_id) as place from fx_scored where fp_type is not null) select event_id, fp_type, case when fp_type in ('GT_MISS', 'MATCHER_MISS') then 'all' when coalesce(confidence, 0) < 0.2 then 'low' else 'sample' end as why from f where fp_type in ('GT_MISS', 'MATCHER_MISS') or coalesce(confidence, 0) < 0.2 or place <= 5", fx=True)
def l4_review_sample(spark, d):
    f = tables(spark, d)[2].where("fp_type is not null")
    w = W.partitionBy("run_key", "fp_type").orderBy(F.md5(F.concat(F.lit("3|"), F.col("event_id").cast("string"))), "event_id")
    always, low = F.col("fp_type").isin("GT_MISS", "MATCHER_MISS"), F.coalesce("confidence", F.lit(0.0)) < 0.2
    why = F.when(always, "all").when(low, "low").otherwise("sample").alias("why")
    return f.withColumn("_i", F.row_number().over(w)).where(always | low | (F.col("_i") <= 5)).select("event_id", "fp_type", why)


@query("r2_auroc_by_pairs", "with p as (select a.run_key, avg(case when coalesce(a.confidence, -1) > coalesce(b.confidence, -1) then 1.0 when coalesce(a.confidence, -1) = coalesce(b.confidence, -1) then 0.5 else 0.0 end) as auroc from fx_scored a join fx_scored b on a.run_key = b.run_key and a.matched and not b.matched group by 1) select run_key, cast(printf('%.3f', auroc::double) as double) as auroc from p", fx=True)
def r2_auroc_by_pairs(spark, d):
    """Pair counting with half a point for a tie, to three digits; the rank form has the same value and needs no self join."""
    from ..functions.scalars import round_half_even

    found = R.auroc(tables(spark, d)[2], ["run_key"], "confidence", F.col("matched"))
    return found.select("run_key", round_half_even(F.col("auroc"), 1000).alias("auroc"))


@query("r5_recall_without_reference", "with n as (select category, count(*) as n_gt from fx_gt group by 1), t as (select category, confidence as s, count(*) filter (where matched) as p, count(*) filter (where not matched) as q from fx_scored group by 1, 2), c as (select *, sum(p) over w as tp, sum(q) over w as fp from t left join n using (category) window w as (partition by category order by s desc nulls last)) select category, case when max(n_gt) > 0 then coalesce(max(tp / n_gt::double) filter (where fp <= 10), 0) end as recall_at_10_fp from c group by 1", fx=True)
def r5_recall_without_reference(spark, d):
    """Recall by category: one without a single reference flag has no recall, rather than a recall of 0."""
    _, gt, flags = tables(spark, d)
    n = flags.select("category").distinct().join(gt.groupBy("category").agg(F.count("*").alias("n_gt")), "category", "left").fillna(0, ["n_gt"])
    return R.recall_at_fp(flags, ["category"], "confidence", F.col("matched"), n, [10])


@query("a47_usage_by_map", "with k as (select event_type, user_id, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1, 2) select user_id, sum(k)::bigint as tokens, string_agg(event_type || '=' || k, ',' order by event_type) as by_type from k group by 1")
def a47_usage_by_map(spark, d):
    """Each request brings a map of tokens by modality; the maps of a user are added key by key."""
    usage = X.table(spark, d, "events").select("user_id", F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("m"))
    n = usage.select("user_id", F.explode("m").alias("modality", "k")).groupBy("user_id", "modality").agg(F.sum("k").alias("k"))
    m = n.groupBy("user_id").agg(F.sum("k").alias("tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "k")))).alias("m"))
    return m.select("user_id", "tokens", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_type"))


#: stratum -> files to choose for each language
QUOTAS = {"clear_positive": 1, "weak_positive": 1, "multi_positive": 1, "clear_negative": 2, "disagreed_negative": 3, "disagreed_positive": 2}
STRATUM = "case when n_gt > 0 and disagreed then 'disagreed_positive' when n_gt > 1 then 'multi_positive' when n_gt = 1 and best >= 0.8 then 'clear_positive' when n_gt = 1 then 'weak_positive' when disagreed then 'disagreed_negative' else 'clear_negative' end"


@query("l5_dev_set", f"""with p as (select quantile_cont(duration_s, 0.9) as p90 from fx_segments), g as (select file_id, count(*) as n_gt, max(coalesce(confidence, 0)) as best from fx_gt group by 1),
v as (select file_id, count(distinct flagged) > 1 as disagreed from (select f.run_key, f.file_id, count(s.event_id) > 0 as flagged from fx_files f left join fx_scored s on s.run_key = f.run_key and s.file_id = f.file_id and s.confidence >= 0.8 group by 1, 2) group by 1),
c as (select distinct b.file_id, b.language, coalesce(n_gt, 0) as n_gt, best, disagreed from fx_base b join fx_segments s using (file_id) left join g using (file_id) join v using (file_id), p where duration_s <= p90), t as (select *, {STRATUM} as stratum from c),
r as (select *, row_number() over (partition by language, stratum order by md5(file_id), file_id) as place from t) select file_id, language, stratum, place from r where place <= case stratum {" ".join(f"when '{k}' then {n}" for k, n in QUOTAS.items())} end""", fx=True)
def l5_dev_set(spark, d):
    """Stratified choice: files up to the 90th percentile of duration, a quota a language and stratum, files on which runs disagree apart."""
    files, gt, flags = tables(spark, d)
    seg = X.segments(X.base(spark, d))
    p90 = seg.agg(F.percentile("duration_s", 0.9).alias("p90"))
    g = gt.groupBy("file_id").agg(F.count("*").alias("n_gt"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("best"))
    sure = flags.where("confidence >= 0.8D").select("run_key", "file_id").distinct().withColumn("flagged", F.lit(True))
    split = files.join(sure, ["run_key", "file_id"], "left").groupBy("file_id", "language").agg((F.count_distinct(F.coalesce("flagged", F.lit(False))) > 1).alias("disagreed"))
    c = split.join(seg, "file_id").crossJoin(F.broadcast(p90)).where("duration_s <= p90").join(g, "file_id", "left").fillna(0, ["n_gt"]).withColumn("stratum", F.expr(STRATUM))
    quota = F.coalesce(*[F.when(F.col("stratum") == k, F.lit(n)) for k, n in QUOTAS.items()])
    w = W.partitionBy("language", "stratum").orderBy(F.md5("file_id"), "file_id")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota).select("file_id", "language", "stratum", "place")


@query("l6_round_robin_head", "with r as (select event_id, category, row_number() over (partition by category order by event_id) as place from fx_base), k as (select *, row_number() over (order by place, category) as turn from r where place <= 4) select event_id, category, turn from k where turn <= 9", fx=True)
def l6_round_robin_head(spark, d):
    """The first files of each bucket, bucket by bucket in turn, up to nine in all."""
    heads = R.top_k(X.base(spark, d).select("event_id", "category", F.lit(0).alias("_z")), ["category"], "_z", 4, "event_id")
    return heads.withColumn("turn", F.row_number().over(W.orderBy("place", "category"))).where("turn <= 9").select("event_id", "category", "turn")  # four rows a bucket
