"""Operators that other queries contain, by themselves (IO1, IO19, A1, SC23, E11, E12, E23, E28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import confusion as C
from ..operators import documents as D
from ..operators import scoring as S
from ..sources import documents as R
from ..sources import fixtures as X
from ..sources import io
from .base import query
from .confusion_queries import FILE_STATE, MODES, RATIOS, tables
from .threshold_queries import MODE_FILES, mode_sweep, sweep_sql

TREE = [
    "concat('/root/', language, '_platform/', case user_id % 2 when 0 then 'TP/Single/' else 'TP/Multi/' end, file_id, '.mp3')",
    "concat('/root/', language, '_platform/FP/', file_id, case user_id % 5 when 2 then '.pdf' else '.WAV' end)",
    "concat('/root/', language, '_fn/', file_id, '.ogg')",
]
FILES = "f as (select distinct file_id, user_id, language from fx_base)"


@query("io1_dataset_tree", f"""with {FILES} select file_id, {TREE[0]} as path, language, 'platform' as category, 'TP' as original_bucket, case user_id % 2 when 0 then 'Single' else 'Multi' end as multiplicity from f
union all select file_id, {TREE[1]}, language, 'platform', 'FP', null from f where user_id % 5 <> 2 union all select file_id, {TREE[2]}, language, null, 'FN', null from f""", fx=True)
def io1_dataset_tree(spark, d):
    paths = X.base(spark, d).select("file_id", "user_id", "language").distinct().select(F.explode(F.array(*map(F.expr, TREE))).alias("path"))
    return io.layout_rows(paths)


@query("a1_confusion_metrics", f"with {FILE_STATE}, c as (select run_key, file_id, " + ", ".join(f"count(*) filter (where file_bucket = '{b}') as {b.lower()}" for b in ("TP", "FP", "FN", "TN")) + f" from pf group by 1, 2 union all select run_key, 'all', " + ", ".join(f"count(*) filter (where file_bucket = '{b}')" for b in ("TP", "FP", "FN", "TN")) + f" from pf group by 1) select *, {RATIOS} from c", fx=True)
def a1_confusion_metrics(spark, d):
    """The four ratios of every run, and of every file by itself, where most have no denominator and are null."""
    files = C.per_file(*tables(spark, d)).select("run_key", F.explode(F.array("file_id", F.lit("all"))).alias("file_id"), "file_bucket")
    counts = [F.count_if(F.col("file_bucket") == b).alias(b.lower()) for b in ("TP", "FP", "FN", "TN")]
    return C.metrics(files.groupBy("run_key", "file_id").agg(*counts))


@query("sc23_five_bins", "select event_id, case when c < 0.2 then '0.0-0.2' when c < 0.4 then '0.2-0.4' when c < 0.6 then '0.4-0.6' when c < 0.8 then '0.6-0.8' else '0.8-1.0' end as bucket from (select event_id, case when event_id % 50 = 0 then 1.0::double else confidence end as c from fx_base) where c is not null", fx=True)
def sc23_five_bins(spark, d):
    c = X.base(spark, d).select("event_id", F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(F.col("confidence")).alias("c"))
    return c.join(F.broadcast(C.five_bins(spark)), (F.col("c") >= F.col("lo")) & (F.col("c") < F.col("hi"))).select("event_id", "bucket")


@query("e11_run_tables", f"with {MODES}, {MODE_FILES}, {sweep_sql('kept', 'mode_score', [0.8], files='mode_files', keys='run_key, mode')}, g as (select run_key, mode, count(*) as n_flags, count(*) filter (where is_dropped) as n_dropped from modes group by 1, 2) select s.run_key, s.mode, tp, fp, fn, tn, recall, specificity, n_flags, n_dropped from sweep s join g using (run_key, mode) where language = 'ALL' and category = 'ALL' and threshold = 0.8", fx=True)
def e11_run_tables(spark, d):
    """Every run and mode in one plan: the sweep's row at 0.8 beside what the mode dropped."""
    at = mode_sweep(spark, d).where("language = 'ALL' and category = 'ALL' and threshold = 0.8D").select("run_key", "mode", "tp", "fp", "fn", "tn", "recall", "specificity")
    n = S.by_mode(tables(spark, d)[2]).groupBy("run_key", "mode").agg(F.count("*").alias("n_flags"), F.count_if("is_dropped").alias("n_dropped"))
    return at.join(n, ["run_key", "mode"])


@query("e12_kept_by_category", f"with {MODES} select run_key, mode, category, count(*) filter (where not is_dropped) as kept, count(*) filter (where is_dropped) as dropped, count(*) filter (where fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE') > 0 as redundant_available from modes group by 1, 2, 3", fx=True)
def e12_kept_by_category(spark, d):
    m = S.by_mode(tables(spark, d)[2])
    return m.groupBy("run_key", "mode", "category").agg(F.count_if(~F.col("is_dropped")).alias("kept"), F.count_if("is_dropped").alias("dropped"), F.bool_or(S.redundant()).alias("redundant_available"))


@query("e23_mean_entropy", "select run_key, matched, avg(entropy_mean) as mean_entropy, count(entropy_mean) as n, count(*) as flags from fx_scored group by 1, 2", fx=True)
def e23_mean_entropy(spark, d):
    return tables(spark, d)[2].groupBy("run_key", "matched").agg(F.avg("entropy_mean").alias("mean_entropy"), F.count("entropy_mean").alias("n"), F.count("*").alias("flags"))


@query("io19_chunk_windows", "select file_id, c.range::int as chunk, c.range * 28.0::double as offset_s, least(28.0::double, duration_s - c.range * 28.0) as length_s from fx_segments, range(0, 30) c where c.range * 28.0 < duration_s", fx=True)
def io19_chunk_windows(spark, d):
    return R.chunk_windows(X.segments(X.base(spark, d)).withColumn("duration_s", F.col("duration_s").cast("double")), 28.0)


@query("e28_prompt_texts", "select 'prompt_v' || item_id % 9 || case item_id % 3 when 0 then '.txt' else '.py' end as name, 'v' || item_id % 9 as version, text, count(*) as n from benchmark group by all")
def e28_prompt_texts(spark, d):
    """Prompts made of the benchmark's texts: of text files as they stand, of Python files by their syntax, named or returned at once."""
    quoted = F.to_json(F.array("text"))
    literal = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    named = F.concat(F.lit("TEXT = "), literal, F.lit("\n\n\ndef get_prompt():\n    return TEXT\n"))
    direct = F.concat(F.lit("def get_prompt() -> str:\n    return "), literal, F.lit("\n"))
    kind = F.col("item_id") % 3
    files = X.table(spark, d, "benchmark").select(
        F.concat(F.lit("prompt_v"), F.col("item_id") % 9, F.when(kind == 0, ".txt").otherwise(".py")).alias("name"), F.when(kind == 0, F.col("text")).when(kind == 1, named).otherwise(direct).alias("source"),
    )
    return R.prompts(files).groupBy("name", "version", "text").agg(F.count("*").alias("n"))


CALLS = "event_id % 5 + 1 as attempt, event_id % 4 = 0 as ok, case event_id % 7 when 1 then 400 when 2 then 429 when 3 then 503 end as code, case event_id % 11 when 4 then 'SAFETY' when 5 then 'MAX_TOKENS' end as reason"


@query("m14_retry_steps", f"with c as (select event_id, {CALLS} from fx_base), s as (select event_id, attempt, case when ok then 'done' when coalesce(code = 400, false) or coalesce(reason = 'SAFETY', false) or attempt >= 4 then 'failed' else 'again' end as step from c) select event_id, step, case when step = 'again' then pow(2.0::double, attempt) end as wait_s from s", fx=True)
def m14_retry_steps(spark, d):
    """Attempts of model calls: what the same input would bring again is not tried again, the rest waits longer each time."""
    calls = X.base(spark, d).selectExpr("event_id", *[c.strip() for c in CALLS.split(", ")])
    s = D.next_step(F.col("attempt"), F.col("ok"), F.col("code"), F.col("reason"), 4, 2.0)
    return calls.select("event_id", s["step"].alias("step"), s["wait_s"].alias("wait_s"))
