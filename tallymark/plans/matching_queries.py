"""Matching and joins (J1-J14, A45, A46, P10-P12, A37-A40, A48, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import confusion as C
from ..operators import matching as M
from ..operators import scoring as S
from ..sources import fixtures as X
from .base import query
from .confusion_queries import FILE_STATE, HITS, matched_index, tables

def with_vectors(spark, d, flags):
    """Flags with the vector of their content: the embedding with the flag's number, counted round."""
    vectors = X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return flags.withColumn("vec_id", F.col("event_id") % F.lit(vectors.count())).join(vectors, "vec_id")


def candidates(spark, d):
    _, gt, flags = tables(spark, d)
    return M.scored_candidates(with_vectors(spark, d, gt), with_vectors(spark, d, flags))


PAIRS = """
vc as (select event_id, embedding::double[] as v from fx_base join embeddings on vec_id = event_id % (select count(*) from embeddings)),
cd as (select s.run_key, s.file_id, g.event_id as gi, s.event_id as mi, g.category as gc, s.category as mc, abs(g.t_sec - s.t_sec)::double as delta, s.t_sec % 28 <= 0.5 or 28 - s.t_sec % 28 <= 0.5 as unk from fx_scored s join fx_gt g using (file_id)),
ct as (select cd.*, (list_cosine_similarity(x.v, y.v) + 1) / 2 as content from cd join vc x on x.event_id = gi join vc y on y.event_id = mi where unk or delta <= 60),
pairs as (select run_key, file_id, gi, mi, greatest(0.0::double, least(1.0::double, 0.70::double * content + 0.30::double * case when unk then 0.7::double else exp(-delta / 20.0::double) end + case when gc = mc then 0.15::double else -0.15::double end)) as score from ct where content >= 0.5)"""


@query("j3_band_candidates", "select s.run_key, s.file_id, g.event_id as gi, s.event_id as mi, abs(g.t_sec - s.t_sec) as delta from fx_scored s join fx_gt g on g.file_id = s.file_id and g.category = s.category and abs(g.t_sec - s.t_sec) <= 15", fx=True)
def j3_band_candidates(spark, d):
    _, gt, flags = tables(spark, d)
    return M.band_candidates(gt, flags)


@query("j4_scored_candidates", f"with {PAIRS} select * from pairs", fx=True)
def j4_scored_candidates(spark, d):
    return candidates(spark, d)


#: a letter of each language's script, for the native excerpts of the fixture
LETTERS = {"hindi": "क", "tamil": "க", "telugu": "క", "kannada": "ಕ", "malayalam": "ക"}


def with_excerpts(flags):
    """Flags with a native excerpt made from their numbers; one in three is in Latin letters and so has no say."""
    letter = F.coalesce(*[F.when(F.col("language") == k, F.lit(v)) for k, v in LETTERS.items()])
    words = F.concat_ws(" ", *[F.concat(F.repeat(F.lit("x"), 1 + F.col("event_id") % n), F.lit("yz")) for n in (2, 3, 5)])
    return flags.withColumn("excerpt", F.when(F.col("event_id") % 3 == 0, words).otherwise(F.regexp_replace(words, F.lit("[xz]"), letter)))


@query("j4_native_candidates")
def j4_native_candidates(spark, d):
    """As j4_scored_candidates, with the likeness of native excerpts where it is more than that of the vectors."""
    _, gt, flags = tables(spark, d)
    side = lambda t: with_excerpts(with_vectors(spark, d, t))
    return M.scored_candidates(side(gt), side(flags), native=True)


#: candidates from the highest score down, each taken if both its flags are free
GREEDY = """
ls as (select run_key, file_id, list({'gs': [gi], 'ms': [mi], 'ss': [score]} order by score desc, gi, mi) as e from pairs group by 1, 2),
rd as (select run_key, file_id, list_reduce(e, lambda a, x: case when list_has_any(a.gs, x.gs) or list_has_any(a.ms, x.ms) then a else {'gs': list_concat(a.gs, x.gs), 'ms': list_concat(a.ms, x.ms), 'ss': list_concat(a.ss, x.ss)} end) as p from ls)
select run_key, file_id, unnest(p.gs) as gi, unnest(p.ms) as mi, unnest(p.ss) as score from rd"""


@query("j5_greedy_assignment", f"with {PAIRS.strip()}, {GREEDY.strip()}", fx=True)
def j5_greedy_assignment(spark, d):
    return M.assign(candidates(spark, d), M.greedy_pairs)


@query("j6_optimal_assignment")
def j6_optimal_assignment(spark, d):
    return M.assign(candidates(spark, d))


def _odd_sum(pairs):
    return (pairs["gi"] + pairs["mi"]) % 5 != 0


@query("j7_verified_assignment")
def j7_verified_assignment(spark, d):
    return M.assign(candidates(spark, d), M.verified_pairs(_odd_sum))


@query("j1_lookup_join", "select e.event_id, s.duration_s, s.snr_db from fx_base e left join fx_segments s on s.file_id = e.file_id and e.event_id % 3 > 0", fx=True)
def j1_lookup_join(spark, d):
    b = X.base(spark, d)
    seg = X.segments(b).withColumnRenamed("file_id", "sf")
    return b.join(seg, (F.col("sf") == F.col("file_id")) & (F.col("event_id") % 3 > 0), "left").select("event_id", "duration_s", "snr_db")


@query("j8_dev_membership", "select event_id from fx_scored where file_id in (select file_id from fx_base where user_id % 8 = 0)", fx=True)
def j8_dev_membership(spark, d):
    b = X.base(spark, d)
    dev = b.where("user_id % 8 = 0").select("file_id").distinct()
    return X.model_flags(b).join(dev, "file_id", "left_semi").select("event_id")


@query("j9_heldout", "select distinct file_id from fx_base where file_id not in (select file_id from fx_base where user_id % 8 = 0)", fx=True)
def j9_heldout(spark, d):
    b = X.base(spark, d)
    return b.select("file_id").distinct().join(b.where("user_id % 8 = 0").select("file_id"), "file_id", "left_anti")


@query("j11_positional_zip", "with a as (select file_id, list(event_id order by event_id) as ids from fx_scored group by 1), b as (select file_id, list(category order by event_id) as cats from fx_scored group by 1) select file_id, unnest(range(0, len(ids))) as pos, unnest(ids) as event_id, unnest(cats) as category from a join b using (file_id) where len(ids) = len(cats)", fx=True)
def j11_positional_zip(spark, d):
    """Index-aligned arrays joined by position, only where both have one length."""
    flags = tables(spark, d)[2]
    one = flags.groupBy("file_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    two = flags.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "category"))).alias("cats"))
    both = one.join(two, "file_id").where(F.size("ids") == F.size("cats"))
    zipped = both.select("file_id", F.posexplode(F.arrays_zip("ids", "cats")).alias("pos", "z"))
    return zipped.select("file_id", "pos", F.col("z.ids").alias("event_id"), F.col("z.cats.category").alias("category"))


@query("j12_matched_lookup", f"with {HITS} select r.run_key, g.event_id, h.gt_index is not null as matched from fx_gt g cross join (select distinct run_key from fx_scored) r left join hits h on h.run_key = r.run_key and h.gt_index = g.event_id", fx=True)
def j12_matched_lookup(spark, d):
    _, gt, flags = tables(spark, d)
    hit = matched_index(flags, gt).select("run_key", F.col("gt_index").alias("event_id")).withColumn("hit", F.lit(True))
    grid = gt.select("event_id").crossJoin(F.broadcast(flags.select("run_key").distinct()))
    return grid.join(hit, ["run_key", "event_id"], "left").select("run_key", "event_id", F.col("hit").isNotNull().alias("matched"))


@query("j13_grid_cross_join", "select run_key, threshold, count(*) filter (where confidence >= threshold) as n from fx_scored cross join (values (0.0::double), (0.5::double), (0.9::double)) t(threshold) group by 1, 2", fx=True)
def j13_grid_cross_join(spark, d):
    at = F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.9))).alias("threshold")
    return tables(spark, d)[2].select("run_key", "confidence", at).groupBy("run_key", "threshold").agg(F.count_if(F.col("confidence") >= F.col("threshold")).alias("n"))


@query("j14_dense_grid", "select c.category, s.status, coalesce(n, 0) as n from (values ('PlatformMove'), ('SuspiciousActivity'), ('Explicit-Flirting')) c(category) cross join (values ('kept'), ('lost'), ('changed')) s(status) left join (select category, case event_id % 2 when 0 then 'kept' else 'lost' end as status, count(*) as n from fx_base group by 1, 2) x on x.category = c.category and x.status = s.status", fx=True)
def j14_dense_grid(spark, d):
    n = X.base(spark, d).groupBy("category", F.expr("case event_id % 2 when 0 then 'kept' else 'lost' end").alias("status")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(c, s) for c in S.CATEGORIES for s in ("kept", "lost", "changed")], "category string, status string")
    return grid.join(n, ["category", "status"], "left").select("category", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query("p7_determination", """with f as (select file_id, user_id, case user_id % 3 when 0 then 'TP' when 1 then 'FP' else 'FN' end as original, case user_id % 2 when 0 then 'PlatformMove' else 'SuspiciousActivity' end as expected from fx_base group by 1, 2),
g as (select file_id, list_sort(list(distinct category)) as cats, arg_min(category, event_id) as first_ from fx_gt group by 1)
select f.file_id, case when original = 'FN' and cats is null then 'TN' else original end as final_bucket, case when original <> 'FN' then expected when cats is not null then first_ end as final_category,
 case original when 'TP' then not coalesce(list_contains(cats, expected), false) when 'FP' then cats is not null else cats is null or len(cats) > 1 end as needs_review, original = 'FN' and cats is null as reassigned from f left join g using (file_id)""", fx=True)
def p7_determination(spark, d):
    b = X.base(spark, d)
    f = b.select("file_id", "user_id").distinct().withColumn("original", F.expr("case user_id % 3 when 0 then 'TP' when 1 then 'FP' else 'FN' end")).withColumn("expected", F.expr("case user_id % 2 when 0 then 'PlatformMove' else 'SuspiciousActivity' end"))
    g = X.gt_flags(b).groupBy("file_id").agg(F.collect_set("category").alias("cats"), F.min_by("category", "event_id").alias("first"))
    j = f.join(g, "file_id", "left")
    fn, none = F.col("original") == "FN", F.col("cats").isNull()
    review = F.when(F.col("original") == "TP", ~F.coalesce(F.array_contains("cats", F.col("expected")), F.lit(False))).when(F.col("original") == "FP", ~none).otherwise(none | (F.size("cats") > 1))
    return j.select("file_id", F.when(fn & none, "TN").otherwise(F.col("original")).alias("final_bucket"), F.when(~fn, F.col("expected")).otherwise(F.col("first")).alias("final_category"), review.alias("needs_review"), (fn & none).alias("reassigned"))


@query("p10_eligible_flags", "select event_id from fx_scored where matched = false", fx=True)
def p10_eligible_flags(spark, d):
    return tables(spark, d)[2].where(F.col("matched") == F.lit(False)).select("event_id")


@query("p11_checked_verdicts", "select event_id, case when fp_type in ('GT_MISS', 'WRONG_CATEGORY', 'MATCHER_MISS', 'DUPLICATE_OR_EXTRA_INSTANCE', 'UNCLEAR') then fp_type else 'UNCLEAR' end as verdict from fx_scored where fp_type is not null", fx=True)
def p11_checked_verdicts(spark, d):
    return tables(spark, d)[2].where("fp_type is not null").select("event_id", S.checked_verdict(F.col("fp_type")).alias("verdict"))


RELATED = "rel as (select s.*, (select min(g.event_id) from fx_gt g where g.file_id = s.file_id) as related_gt, event_id % 6 > 0 as verified from fx_scored s where fp_type is not null)"


@query("p12_duplicate_rule", f"with {HITS}, {RELATED} select rel.event_id, case when verified and fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE' and h.gt_index is null then 'MATCHER_MISS' else fp_type end as final_type, not verified and fp_type in ('DUPLICATE_OR_EXTRA_INSTANCE', 'MATCHER_MISS') as low_confidence from rel left join hits h on h.run_key = rel.run_key and h.gt_index = rel.related_gt", fx=True)
def p12_duplicate_rule(spark, d):
    _, gt, flags = tables(spark, d)
    first = gt.groupBy("file_id").agg(F.min("event_id").alias("related_gt"))
    verdicts = flags.where("fp_type is not null").join(first, "file_id", "left").withColumn("verified", F.col("event_id") % 6 > 0)
    return S.enforce_duplicates(verdicts, matched_index(flags, gt)).select("event_id", "final_type", "low_confidence")


@query("e8_breakdown_bundle", "select run_key, grouping(language) = 0 as by_language, grouping(category) = 0 as by_category, coalesce(language, category, 'ALL') as grp, fp_type, count(*) as n from fx_scored where fp_type is not null group by grouping sets ((run_key, fp_type), (run_key, language, fp_type), (run_key, category, fp_type))", fx=True)
def e8_breakdown_bundle(spark, d):
    f = tables(spark, d)[2].where("fp_type is not null")
    cut = F.explode(F.array(*[F.struct(F.lit(a).alias("by_language"), F.lit(b).alias("by_category"), g.alias("grp")) for a, b, g in ((False, False, F.lit("ALL")), (True, False, F.col("language")), (False, True, F.col("category")))])).alias("c")
    return f.select("run_key", "fp_type", cut).groupBy("run_key", "c.by_language", "c.by_category", "c.grp", "fp_type").agg(F.count("*").alias("n"))


@query("a38_fp_entropy", "select fp_type, avg(entropy_mean) as mean_entropy, count(entropy_mean) as n from fx_scored where fp_type is not null group by 1", fx=True)
def a38_fp_entropy(spark, d):
    return tables(spark, d)[2].where("fp_type is not null").groupBy("fp_type").agg(F.avg("entropy_mean").alias("mean_entropy"), F.count("entropy_mean").alias("n"))


@query("a39_adjusted_precision", f"""with {FILE_STATE}, rc as (select run_key, file_id, count(*) filter (where fp_type in ('GT_MISS', 'MATCHER_MISS')) as right_, count(*) filter (where fp_type = 'DUPLICATE_OR_EXTRA_INSTANCE') as dup from fx_scored group by 1, 2),
j as (select pf.*, coalesce(right_, 0) as right_, coalesce(dup, 0) as dup from pf left join rc using (run_key, file_id)),
s as (select run_key, sum(flag_tp) as tp0, sum(flag_fp) as fp0, sum(flag_tp + right_) as tp1, sum(flag_fp - right_ - dup) as fp1, count(*) filter (where file_bucket = 'TP') as ft0, count(*) filter (where file_bucket = 'FP') as ff0, count(*) filter (where file_bucket = 'TP' or (file_bucket = 'FP' and right_ > 0)) as ft1, count(*) filter (where file_bucket = 'FP' and right_ = 0) as ff1 from j group by 1)
select run_key, tp0 / nullif(tp0 + fp0, 0)::double as raw_flag, tp1 / nullif(tp1 + fp1, 0)::double as adjusted_flag, ft0 / nullif(ft0 + ff0, 0)::double as raw_file, ft1 / nullif(ft1 + ff1, 0)::double as adjusted_file from s""", fx=True)
def a39_adjusted_precision(spark, d):
    files, gt, flags = tables(spark, d)
    right = flags.groupBy("run_key", "file_id").agg(F.count_if(F.col("fp_type").isin("GT_MISS", "MATCHER_MISS")).alias("right"), F.count_if(F.col("fp_type") == "DUPLICATE_OR_EXTRA_INSTANCE").alias("dup"))
    j = C.per_file(files, gt, flags).join(right, ["run_key", "file_id"], "left").fillna(0, ["right", "dup"])
    tp, fp, b, r = F.col("flag_tp"), F.col("flag_fp"), F.col("file_bucket"), F.col("right")
    s = j.groupBy("run_key").agg(F.sum(tp).alias("tp0"), F.sum(fp).alias("fp0"), F.sum(tp + r).alias("tp1"), F.sum(fp - r - F.col("dup")).alias("fp1"), F.count_if(b == "TP").alias("ft0"), F.count_if(b == "FP").alias("ff0"), F.count_if((b == "TP") | ((b == "FP") & (r > 0))).alias("ft1"), F.count_if((b == "FP") & (r == 0)).alias("ff1"))
    share = lambda a, c: C.ratio(F.col(a), F.col(a) + F.col(c))
    return s.select("run_key", share("tp0", "fp0").alias("raw_flag"), share("tp1", "fp1").alias("adjusted_flag"), share("ft0", "ff0").alias("raw_file"), share("ft1", "ff1").alias("adjusted_file"))


@query("a48_eligibility_reconciliation", f"with {FILE_STATE} select a.run_key, n_eligible, n_fp, n_eligible = n_fp as equal from (select run_key, count(*) as n_eligible from fx_scored where not matched group by 1) a join (select run_key, sum(flag_fp)::bigint as n_fp from pf group by 1) b using (run_key)", fx=True)
def a48_eligibility_reconciliation(spark, d):
    files, gt, flags = tables(spark, d)
    a = flags.where(~F.col("matched")).groupBy("run_key").agg(F.count("*").alias("n_eligible"))
    b = C.per_file(files, gt, flags).groupBy("run_key").agg(F.sum("flag_fp").alias("n_fp"))
    return a.join(b, "run_key").withColumn("equal", F.col("n_eligible") == F.col("n_fp"))


@query("e7_flag_report", "select run_key, file_id, language, event_id, category, fp_type, confidence, entropy_mean from fx_scored where fp_type is not null", fx=True)
def e7_flag_report(spark, d):
    return tables(spark, d)[2].where("fp_type is not null").select("run_key", "file_id", "language", "event_id", "category", "fp_type", "confidence", "entropy_mean")


@query("a37_fp_breakdown", "with c as (select run_key, cut.axis, cut.grp, fp_type from fx_scored, lateral (values ('overall', 'ALL'), ('language', language), ('category', category)) cut(axis, grp) where fp_type is not null) select run_key, axis, grp, fp_type, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by run_key, axis, grp) as pct from c group by 1, 2, 3, 4", fx=True)
def a37_fp_breakdown(spark, d):
    """Types of false positives overall, by language and by category, as counts and shares of their group."""
    from pyspark.sql import Window as W

    cuts = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), g.alias("grp")) for a, g in (("overall", F.lit("ALL")), ("language", F.col("language")), ("category", F.col("category")))])).alias("c")
    n = tables(spark, d)[2].where("fp_type is not null").select("run_key", "fp_type", cuts).groupBy("run_key", "c.axis", "c.grp", "fp_type").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("run_key", "axis", "grp")))


REVIEW = "rv as (select event_id, case event_id % 5 when 0 then 'GT_MISS' when 1 then null when 2 then 'MATCHER_MISS' else fp_mark end as human from fx_base b join (select event_id as e, fp_mark from fx_scored) s on s.e = b.event_id where event_id % 3 > 0)"


@query("a40_review_agreement", f"with {REVIEW}, j as (select fp_type, human = fp_type as agrees from fx_scored join rv using (event_id) where fp_type is not null and human is not null) select coalesce(fp_type, 'ALL') as fp_type, count(*) as n, count(*) filter (where agrees) as n_agree, 100.0 * count(*) filter (where agrees) / count(*) as pct from j group by grouping sets ((fp_type), ())", fx=True)
def a40_review_agreement(spark, d):
    """Verdicts beside those of a review sheet that people filled in for some flags; empty lines do not count."""
    flags = tables(spark, d)[2]
    human = F.expr("case event_id % 5 when 0 then 'GT_MISS' when 1 then null when 2 then 'MATCHER_MISS' else fp_mark end")
    review = flags.where("event_id % 3 > 0").select("event_id", human.alias("human")).where("human is not null")
    j = flags.where("fp_type is not null").select("event_id", "fp_type").join(review, "event_id")
    judged = j.withColumn("agrees", F.col("human") == F.col("fp_type"))
    g = C.with_all(judged, "fp_type").groupBy("fp_type").agg(F.count("*").alias("n"), F.count_if("agrees").alias("n_agree"))
    return g.withColumn("pct", 100.0 * F.col("n_agree") / F.col("n"))


MUTUAL = """mu as (select run_key, file_id, gi, mi, gc = mc as confirmed from (select s.run_key, s.file_id, g.event_id as gi, s.event_id as mi, g.category as gc, s.category as mc,
  row_number() over (partition by s.run_key, s.event_id order by abs(g.t_sec - s.t_sec), g.event_id) as a, row_number() over (partition by s.run_key, g.event_id order by abs(g.t_sec - s.t_sec), s.event_id) as b
  from fx_scored s join fx_gt g on g.file_id = s.file_id and abs(g.t_sec - s.t_sec) <= {w}) where a = 1 and b = 1)"""


def nearest(spark, d, seconds):
    """Pairs of each other's nearest flags within a file, with the verdict on them: only equal categories are confirmed."""
    _, gt, flags = tables(spark, d)
    return M.mutual_pairs(M.near_pairs(gt, flags, seconds), ["delta"]).withColumn("confirmed", F.col("gc") == F.col("mc"))


@query("a45_match_reliability", f"with {MUTUAL.format(w=60)} select run_key, count(*) as n_proposed, count(*) filter (where confirmed) as n_confirmed, count(*) filter (where confirmed) / count(*)::double as match_reliability from mu group by 1", fx=True)
def a45_match_reliability(spark, d):
    pairs = nearest(spark, d, 60)
    return M.reliability(pairs, pairs.where("confirmed"))


@query("a46_matcher_stability", f"with {MUTUAL.format(w=60)}, m2 as ({MUTUAL.format(w=30).removeprefix('mu as (')}, t as (select run_key, file_id, gi, mi, 1 as w from mu union all select run_key, file_id, gi, mi, 2 from m2), p as (select run_key, file_id, gi, mi, sum(w) as w from t group by 1, 2, 3, 4) select run_key, file_id, bool_and(w = 3) as stable from p group by 1, 2", fx=True)
def a46_matcher_stability(spark, d):
    """The same matcher twice, the second time with a narrower window: files whose pairs are all the same are stable."""
    return M.same_pairs(nearest(spark, d, 60), nearest(spark, d, 30))


def said(c):
    """A text made from a flag's number."""
    return F.expr(f"concat(char(97 + {c} % 5), repeat(concat(char(102 + {c} % 7), ' '), cast({c} % 11 as int) + 1), {c} % 1000)")


@query("j3_prematch")
def j3_prematch(spark, d):
    """Candidates of one category within 15 s whose texts are alike, assigned greedily by likeness."""
    _, gt, flags = tables(spark, d)
    alike = M.prematched(M.band_candidates(gt, flags), said("gi"), said("mi"), 0.5).select("run_key", "file_id", "gi", "mi", F.col("similarity").alias("score"))
    return M.assign(alike, M.greedy_pairs)


PRUNED = """
pr as (select s.run_key, {gi} as a, {mi} as b from fx_scored s join fx_gt g on g.file_id = s.file_id and g.category = s.category and abs(g.t_sec - s.t_sec) <= 15),
bd as (select run_key, 2.0::double * least(length(a), length(b)) / (length(a) + length(b)) as by_length,
  2.0::double * list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) / (length(a) + length(b)) as by_letters from pr)
select run_key, count(*) as pairs, count(*) filter (where by_length >= 0.5) as after_length, count(*) filter (where by_length >= 0.5 and by_letters >= 0.5) as after_letters from bd group by 1"""


def said_sql(c):
    return f"chr((97 + {c} % 5)::int) || repeat(chr((102 + {c} % 7)::int) || ' ', ({c} % 11)::int + 1) || ({c} % 1000)"


@query("j3_pruned_pairs", "with " + PRUNED.strip().format(gi=said_sql("g.event_id"), mi=said_sql("s.event_id")), fx=True)
def j3_pruned_pairs(spark, d):
    """How many candidate pairs of j3_prematch each bound leaves for the comparison of texts."""
    _, gt, flags = tables(spark, d)
    a, b = said("gi"), said("mi")
    fits = lambda bound: F.count_if(bound >= 0.5)
    by_length, by_letters = M.ratio_bound_by_length(a, b), M.ratio_bound_by_letters(a, b)
    counts = [F.count("*").alias("pairs"), fits(by_length).alias("after_length"), fits(F.least(by_length, by_letters)).alias("after_letters")]
    return M.band_candidates(gt, flags).groupBy("run_key").agg(*counts)
