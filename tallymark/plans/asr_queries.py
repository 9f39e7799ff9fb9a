"""Speech recognition and translation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asr as A
from ..operators import confusion as C
from ..sources import fixtures as X
from .base import query

WORDS = "string_split(text, ' ')"
HYP = f"array_to_string(list_transform(list_filter(list_zip({WORDS}, range(1, len({WORDS}) + 1)), lambda z: z[2] % 7 > 0), lambda z: z[1]), ' ')"
ASR = f"asr as (select item_id, text as ref, {HYP} as hyp from benchmark)"
NORM = "trim(regexp_replace(regexp_replace(regexp_replace({c}, '\\[?\\s*inaudible\\s*\\]?', ' ', 'gi'), '\\p{{P}}', ' ', 'g'), '\\s+', ' ', 'g'))"


def pairs(spark, d):
    """Reference texts and hypotheses that lack every seventh word."""
    b = X.table(spark, d, "benchmark")
    kept = F.filter(F.split("text", " "), lambda w, i: (i + 1) % 7 > 0)
    return b.select("item_id", F.col("text").alias("ref"), F.array_join(kept, " ").alias("hyp"))


#: The hypothesis lacks words of the reference and has no others, so the cheapest alignment deletes them.
LOST = f"w as (select item_id, len(list_filter(string_split({NORM.format(c='ref')}, ' '), lambda x: x <> '')) as r, len(list_filter(string_split({NORM.format(c='hyp')}, ' '), lambda x: x <> '')) as h from asr)"


@query("t1_edit_alignment", f"with {ASR}, {LOST} select item_id, 0 as substitutions, (r - h)::int as deletions, 0 as insertions, h::int as matches from w")
def t1_edit_alignment(spark, d):
    return A.word_error_rate(pairs(spark, d)).select("item_id", "edits.*")


@query("t2_word_error_rate", f"with {ASR}, {LOST} select item_id, r as ref_words, (r - h) / nullif(r, 0)::double as wer from w")
def t2_word_error_rate(spark, d):
    return A.word_error_rate(pairs(spark, d)).select("item_id", "ref_words", "wer")


@query("t3_char_error_rate", f"with {ASR}, n as (select item_id, replace({NORM.format(c='ref')}, ' ', '') as r, replace({NORM.format(c='hyp')}, ' ', '') as h from asr where regexp_full_match(ref, '[\\x01-\\x7f]*')) select item_id, levenshtein(r, h) / nullif(length(r), 0)::double as cer from n")
def t3_char_error_rate(spark, d):
    p = pairs(spark, d).where(F.regexp_like("ref", F.lit(r"^[\x01-\x7f]*$")))
    return p.select("item_id", A.char_error_rate(F.col("ref"), F.col("hyp")).alias("cer"))


@query("t4_term_recall", f"with {ASR}, e as (select item_id, i, list_filter(string_split({NORM.format(c='array_to_string(string_split(ref, chr(32))[i * 5 + 1:i * 5 + 3 + i], chr(32))')}, ' '), lambda w: w <> '') as ws, string_split({NORM.format(c='hyp')}, ' ') as known from asr, range(0, 4) r(i)) select item_id, i::int as i, len(list_filter(ws, lambda w: list_contains(known, w))) / len(ws)::double >= 0.7 as preserved from e where len(ws) > 0")
def t4_term_recall(spark, d):
    p = pairs(spark, d).select("item_id", "ref", "hyp", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    excerpt = F.array_join(F.slice(F.split("ref", " "), F.col("i") * 5 + 1, F.col("i") + 3), " ")
    return p.select("item_id", "i", A.preserved(excerpt, F.col("hyp")).alias("preserved")).where("preserved is not null")


SEGS = "sg as (select conv_id, (turn * 15)::double as start_s, (15 * count(*) over (partition by conv_id) + 5)::double as duration_s, lead((turn * 15)::double) over (partition by conv_id order by turn) as nxt, count(*) over (partition by conv_id) as k from conversations)"


@query("t6_boundary_corruption", f"with {SEGS}, du as (select conv_id, max(duration_s) as dur from sg group by 1), bo as (select conv_id, b * 10.0::double as b from du, range(1, 200) r(b) where b * 10.0 < dur), m as (select bo.conv_id, bo.b, bool_or(k > 1 and start_s + 0.5 < bo.b and bo.b < coalesce(nxt, duration_s) - 0.05) as bad from bo join sg using (conv_id) group by 1, 2), t as (select du.conv_id, count(m.b) as n_boundaries, count(*) filter (where bad) as n_corrupted from du left join m using (conv_id) group by 1) select *, n_corrupted / nullif(n_boundaries, 0)::double as rate from t")
def t6_boundary_corruption(spark, d):
    t = X.table(spark, d, "conversations")
    n = t.groupBy("conv_id").agg((F.count("*") * 15 + 5).cast("double").alias("duration_s"))
    segs = t.select("conv_id", (F.col("turn") * 15).cast("double").alias("start_s")).join(n, "conv_id")
    return A.boundary_corruption(segs, "conv_id", 10.0)


SEM = "sem as (select item_id, item_id % 3 as chunk, case item_id % 4 when 0 then 'hindi' when 1 then 'tamil' else 'telugu' end as language, len(string_split(text, ' ')) as ref_words, (item_id * 7) % 5 + 0 as a1, case when item_id % 3 = 0 then 2 else 0 end as a2 from benchmark)"


def semantic(spark, d):
    """Judged discrepancies per item: an array of (category, words)."""
    b = X.table(spark, d, "benchmark")
    disc = F.array(F.struct(F.lit("meaning").alias("category"), F.expr("cast((item_id * 7) % 5 as int)").alias("words")), F.struct(F.lit("omission").alias("category"), F.expr("case when item_id % 3 = 0 then 2 else 0 end").alias("words")))
    return b.select("item_id", F.expr("item_id % 3").alias("chunk"), F.expr("case item_id % 4 when 0 then 'hindi' when 1 then 'tamil' else 'telugu' end").alias("language"), F.size(F.split("text", " ")).alias("ref_words"), disc.alias("discrepancies"))


def affected():
    return F.aggregate("discrepancies", F.lit(0), lambda s, x: s + x["words"])


@query("t7_semantic_wer", f"with {SEM} select item_id, (a1 + a2) / ref_words::double as semantic_wer from sem")
def t7_semantic_wer(spark, d):
    return semantic(spark, d).select("item_id", C.ratio(affected(), F.col("ref_words")).alias("semantic_wer"))


@query("a32_micro_average", f"with {SEM} select chunk, sum((a1 + a2) / ref_words::double * ref_words) filter (where ref_words > 0) / sum(ref_words) filter (where ref_words > 0) as micro from sem group by 1")
def a32_micro_average(spark, d):
    s = semantic(spark, d).withColumn("ser", C.ratio(affected(), F.col("ref_words")))
    return s.groupBy("chunk").agg(A.micro_average(F.col("ser"), F.col("ref_words")).alias("micro"))


@query("a33_overall_by_chunk", f"with {SEM} select chunk, count(*) as n, avg((a1 + a2) / ref_words::double) as mean_ser, sum(ref_words)::bigint as words from sem group by 1")
def a33_overall_by_chunk(spark, d):
    s = semantic(spark, d).withColumn("ser", C.ratio(affected(), F.col("ref_words")))
    return s.groupBy("chunk").agg(F.count("*").alias("n"), F.avg("ser").alias("mean_ser"), F.sum("ref_words").alias("words"))


@query("a34_semantic_comparison", f"with {SEM} select chunk, language, avg((a1 + a2) / ref_words::double) as mean_ser from sem group by 1, 2")
def a34_semantic_comparison(spark, d):
    s = semantic(spark, d).withColumn("ser", C.ratio(affected(), F.col("ref_words")))
    return s.groupBy("chunk", "language").agg(F.avg("ser").alias("mean_ser"))


BIN = "case when v >= 1.5 then '1.5+' else printf('%.1f-%.1f', trunc(v / 0.1::double) / 10, (trunc(v / 0.1::double) + 1) / 10) end"


@query("a35_wer_buckets", f"with {SEM}, v as (select (item_id % 17) / 10.0::double as v, (a1 + a2) / ref_words::double as s from sem) select {BIN} as bucket, count(*) as n, avg(s) as mean, min(s) as least, max(s) as most from v group by 1")
def a35_wer_buckets(spark, d):
    s = semantic(spark, d).withColumn("raw", F.expr("(item_id % 17) / 10.0D")).withColumn("ser", C.ratio(affected(), F.col("ref_words")))
    return A.bucket_stats(s, "raw", "ser")


@query("a42_error_rate_per_call", f"with {SEM} select item_id, least(1.0, greatest(a1 + a2 - 1, 0) / ref_words::double) as ser from sem")
def a42_error_rate_per_call(spark, d):
    return semantic(spark, d).select("item_id", A.semantic_error_rate(affected() - 1, F.col("ref_words")).alias("ser"))


@query("v3_combined_pivot", f"with {SEM} select language, item_id % 2 as model, count(*) filter (where chunk = 0) as n_0, avg(ref_words) filter (where chunk = 0) as words_0, count(*) filter (where chunk = 1) as n_1, avg(ref_words) filter (where chunk = 1) as words_1 from sem where chunk < 2 group by 1, 2")
def v3_combined_pivot(spark, d):
    s = semantic(spark, d).where("chunk < 2").withColumn("model", F.expr("item_id % 2"))
    p = s.groupBy("language", "model").pivot("chunk", [0, 1]).agg(F.count(F.lit(1)).alias("n"), F.avg("ref_words").alias("words"))
    return p.select("language", "model", F.coalesce("0_n", F.lit(0)).alias("n_0"), F.col("0_words").alias("words_0"), F.coalesce("1_n", F.lit(0)).alias("n_1"), F.col("1_words").alias("words_1"))


@query("e22_reference_rows", "select conv_id, string_agg(text, ' ' order by turn) as full_text, sum(len(list_filter(string_split(text, ' '), lambda w: w <> '')))::bigint as n_words from conversations group by 1")
def e22_reference_rows(spark, d):
    t = X.table(spark, d, "conversations")
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    g = t.groupBy("conv_id").agg(full.alias("full_text"))
    return g.withColumn("n_words", F.size(F.filter(F.split("full_text", " "), lambda w: w != "")).cast("long"))


JUDGED = "v as (select language, item_id % 2 as source, least(1.0, greatest(a1 + a2 - 1, 0) / ref_words::double) as ser, greatest(a1 + a2 - 1, 0) as aff, ref_words, case item_id % 5 when 0 then 'no' when 1 then 'partly' else 'yes' end as tone, case item_id % 4 when 0 then 'no' else 'yes' end as intent, item_id % 3 as n_moments, case when item_id % 3 > 0 then 1 else 0 end as n_kept, case when item_id % 3 > 1 then 1 else 0 end as n_lost from sem)"


@query("a41_translation_summary", f"with {SEM}, {JUDGED}, l as (select * from v union all select * replace ('ALL' as language) from v) select source, language, count(*) as n, sum(aff) / sum(ref_words)::double as micro_ser, avg(ser) as mean_ser, median(ser) as median_ser, " + ", ".join(f"avg(({c} = '{a}')::int) as {c}_{a}" for c in ("tone", "intent") for a in ("yes", "no")) + ", sum(n_moments)::bigint as moments, sum(n_kept) / nullif(sum(n_moments), 0)::double as preserved_rate, sum(n_lost) / nullif(sum(n_moments), 0)::double as lost_rate from l group by 1, 2")
def a41_translation_summary(spark, d):
    """Error rates, tone and intent, and the status of the moments that matter, by source overall and by language."""
    status = F.slice(F.array(F.lit("preserved"), F.lit("lost")), F.lit(1), (F.col("item_id") % 3).cast("int"))
    s = semantic(spark, d).withColumns({
        "source": F.col("item_id") % 2, "ser": A.semantic_error_rate(affected() - 1, F.col("ref_words")), "aff": F.greatest(affected() - 1, F.lit(0)),
        "tone": F.expr("case item_id % 5 when 0 then 'no' when 1 then 'partly' else 'yes' end"), "intent": F.expr("case item_id % 4 when 0 then 'no' else 'yes' end"), "moments": status,
    })
    return A.translation_summary(C.with_all(s, "language"), ["source", "language"], ["preserved", "lost"])
