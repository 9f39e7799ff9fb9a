"""Sources, incremental state and set operations over the fixtures (IO*, U*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scoring import CATEGORIES
from ..sources import fixtures as X
from ..sources import io
from .base import query
from .confusion_queries import tables


@query("io3_cell_counts", "select language, category, count(distinct file_id) as n from fx_base group by 1, 2", fx=True)
def io3_cell_counts(spark, d):
    return X.base(spark, d).groupBy("language", "category").agg(F.count_distinct("file_id").alias("n"))


@query("io3_empty_cells", "select l.language, c.category, b.bucket from (select distinct language from fx_base) l cross join (values ('PlatformMove'), ('SuspiciousActivity'), ('Explicit-Flirting')) c(category) cross join (values ('TP'), ('FP'), ('FN')) b(bucket) where not exists (select 1 from fx_base x where x.language = l.language and x.category = c.category and b.bucket = case x.user_id % 2 when 0 then 'TP' else 'FP' end)", fx=True)
def io3_empty_cells(spark, d):
    b = X.base(spark, d)
    cats, buckets = F.array(*map(F.lit, CATEGORIES)), F.array(F.lit("TP"), F.lit("FP"), F.lit("FN"))
    grid = b.select("language").distinct().select("language", F.explode(cats).alias("category")).select("language", "category", F.explode(buckets).alias("bucket"))
    there = b.select("language", "category", F.expr("case user_id % 2 when 0 then 'TP' else 'FP' end").alias("bucket")).distinct()
    return grid.join(there, ["language", "category", "bucket"], "left_anti")


@query("io4_first_wins", "select file_id, min(event_id) as event_id, arg_min(category, event_id) as category from fx_base group by 1", fx=True)
def io4_first_wins(spark, d):
    return io.first_wins(X.base(spark, d).select("file_id", "event_id", "category"), ["file_id"], "event_id")


@query("io7_score_input", "select distinct s.run_key, s.file_id from fx_scored s where s.file_id in (select file_id from fx_gt)", fx=True)
def io7_score_input(spark, d):
    _, gt, flags = tables(spark, d)
    return flags.select("run_key", "file_id").distinct().join(gt.select("file_id"), "file_id", "left_semi").select("run_key", "file_id")


@query("io10_keyed_merge", "select run_key, event_id, 'old' as origin from fx_scored where run_key <> 'm2' union all select run_key, event_id, 'new' from fx_scored where run_key = 'm2' and event_id % 2 = 0", fx=True)
def io10_keyed_merge(spark, d):
    flags = tables(spark, d)[2].select("run_key", "event_id")
    return io.keyed_merge(flags.withColumn("origin", F.lit("old")), flags.where("run_key = 'm2' and event_id % 2 = 0").withColumn("origin", F.lit("new")), ["run_key"])


@query("io11_write_back", "with n as (select run_key, file_id, count(*) as n, count(*) filter (where event_id % 50 <> 1) as m from fx_scored group by 1, 2) select s.run_key, s.file_id, s.event_id, case when n = m then event_id % 3 end as note from fx_scored s join n using (run_key, file_id)", fx=True)
def io11_write_back(spark, d):
    flags = tables(spark, d)[2].select("run_key", "file_id", "event_id")
    notes = flags.where("event_id % 50 <> 1").withColumn("note", F.expr("event_id % 3"))
    return io.write_back(flags, notes, ["run_key", "file_id", "event_id"], ["note"])


@query("io12_resume", "select file_id from (select distinct file_id, user_id from fx_base) where user_id % 3 > 0", fx=True)
def io12_resume(spark, d):
    f = X.base(spark, d).select("file_id", "user_id").distinct()
    done = f.withColumn("status", F.expr("case user_id % 3 when 0 then 'success' else 'error' end"))
    return io.todo(f, done, ["file_id"], F.col("status") == "success").select("file_id")


@query("u1_union_all", "select event_id, 'gt' as side from fx_gt union all select event_id, 'model' from fx_scored", fx=True)
def u1_union_all(spark, d):
    _, gt, flags = tables(spark, d)
    return gt.select("event_id", F.lit("gt").alias("side")).unionByName(flags.select("event_id", F.lit("model").alias("side")))


@query("u2_keyed_union", "select event_id, case when event_id % 2 = 0 then 'second' else 'first' end as origin from fx_base where event_id % 3 > 0 or event_id % 2 = 0", fx=True)
def u2_keyed_union(spark, d):
    b = X.base(spark, d).select("event_id")
    return io.keyed_union(b.where("event_id % 3 > 0").withColumn("origin", F.lit("first")), b.where("event_id % 2 = 0").withColumn("origin", F.lit("second")), ["event_id"])


@query("u3_missing_results", "(select file_id from fx_base except select file_id from fx_scored where run_key = 'm1' and category = 'PlatformMove')", fx=True)
def u3_missing_results(spark, d):
    b, flags = X.base(spark, d), tables(spark, d)[2]
    return b.select("file_id").distinct().exceptAll(flags.where("run_key = 'm1' and category = 'PlatformMove'").select("file_id").distinct())


@query("u3_common_files", "select file_id from fx_scored where run_key = 'm1' intersect select file_id from fx_scored where run_key = 'm2'", fx=True)
def u3_common_files(spark, d):
    flags = tables(spark, d)[2]
    one = lambda r: flags.where(F.col("run_key") == r).select("file_id")
    return one("m1").intersect(one("m2"))


@query("u4_membership", "select event_id from fx_base where language in ('tamil', 'hindi')", fx=True)
def u4_membership(spark, d):
    return X.base(spark, d).where(F.col("language").isin("tamil", "hindi")).select("event_id")


@query("e1_wire_rename", "select event_id, category as ground_truth_category, printf('%02d:%02d', t_sec // 60, t_sec % 60) as ground_truth_timestamp from fx_gt", fx=True)
def e1_wire_rename(spark, d):
    from ..functions.scalars import clock, first_clock

    g = X.gt_flags(X.base(spark, d)).select("event_id", F.array(F.struct(F.col("category").alias("f"), F.concat(F.lit("at "), clock(F.col("t_sec")), F.lit(" h")).alias("t"))).alias("d"))
    renamed = F.transform("d", lambda x: F.struct(x["f"].alias("ground_truth_category"), first_clock(x["t"]).alias("ground_truth_timestamp")))
    return g.select("event_id", F.explode(renamed).alias("x")).select("event_id", "x.*")


@query("e24_text_fallback", "select conv_id, turn, coalesce(nullif(case when turn % 2 = 0 then text else '' end, ''), role) as shown from conversations")
def e24_text_fallback(spark, d):
    t = X.table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.coalesce(F.nullif(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""), F.lit("")), "role").alias("shown"))


