"""Quality rules with adaptive thresholds (operator 10).

Every document gets integer counts; each (language, source) pair gets a mergeable
quantile sketch per measure, and a document is rejected when a measure lies beyond
the limit of its own group. The sketch is a log-linear histogram: exact below 128, then
64 buckets per power of two, so two sketches merge by adding counts, the result does
not depend on how rows were partitioned, and a quantile is off by less than 1/64 of its
value. Each language's sketch is merged with the one of all documents, scaled down to
``shrink`` documents, and each group's with its language's, scaled alike: small groups
lean on their language, large ones on themselves.

Limits come from the percentiles of the merged sketch, by their distance d from the
median: where d + slack grows at least ``JUMP``-fold from one percentile to the next,
the group has a far part, and the limit is the geometric middle of the widest such jump;
else it is ``FAR`` times the distance of the 99th (or 1st) percentile, plus the slack. The
slack of a measure is what one chance event adds in a text of ``MIN_WORDS`` words.

Defined cases: null or empty text has no words and fails the base rule; null language
or source forms a group of its own; repeated rows count once each; texts of any length are
read whole; a value equal to a limit is within it, and one of exactly MIN_WORDS words or
MAX_REPEAT_PERCENT passes the base rule; an empty table gives an empty result; columns beyond
the needed ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, keep_rows, staged, tidied, utf8

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SHRINK = 50
JUMP = 3
FAR = 3
#: Weight of one document in a merged sketch; whole numbers keep the merge exact.
UNIT = 1024
#: measure -> (numerator, per how many words, slack, whether small values are limited too)
MEASURES = {
    "repeat": ("n_repeat_words", 1000, 120, False),
    "symbol": ("n_symbols", 1000, 20, False),
    "dup_line": ("n_dup_lines", 1000, 20, False),
    "word_len": ("word_chars", 100, 20, True),
}


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs at least twice, the first one included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def count_text(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [count_text(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))]
        keys = ["doc_id", "lang", "source", "text_hash"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *columns], names=[*keys, *COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a hash of the text and the five counts of every row."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, lang string, source string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text"), F.xxhash64("text").alias("text_hash"), "lang", "source").mapInArrow(tidied(_count_batches), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measure(name: str) -> Column:
    numerator, per, *_ = MEASURES[name]
    return F.expr(f"{numerator} * {per} div greatest(n_words, 1)")


def bucket(value: str) -> Column:
    """Sketch bucket of a non-negative integer column."""
    shift = f"greatest(length(bin({value})) - 7, 0)"
    return F.expr(f"cast(64 * {shift} + shiftright({value}, {shift}) as long)")


def bucket_top(b: str) -> Column:
    """Largest integer that falls into a bucket."""
    shift = f"greatest({b} div 64 - 1, 0)"
    return F.expr(f"cast(shiftleft({b} - 64 * {shift} + 1, cast({shift} as int)) - 1 as long)")


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one sketch per group and measure, over base-passing documents."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), measure(m).alias("v")) for m in MEASURES])
    long = counted.where(~base_failed()).select("lang", "source", F.explode(values).alias("m")).select("lang", "source", "m.measure", "m.v")
    return long.groupBy("lang", "source", "measure", bucket("v").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, shrink: int) -> DataFrame:
    """(lang, source, measure, bucket, w): each group's sketch with its language's added, and that with all documents'."""

    def level(*keys: str) -> DataFrame:
        return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))

    def lean(own: DataFrame, on: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
        """``own`` sketches by ``keys``, and those of ``on`` (weights w) scaled to ``shrink`` documents beside each."""
        total = on.groupBy(*shared, "measure").agg(F.sum("w").alias("whole"))
        mine = own.select(*keys, "measure").distinct()
        behind = on.join(total, [*shared, "measure"]).select(*shared, "measure", "bucket", F.expr(f"{shrink * UNIT} * w div whole").alias("w"))
        beside = mine.join(behind, [*shared, "measure"]).select(*keys, "measure", "bucket", "w")
        weighed = own.select(*keys, "measure", "bucket", (F.col("n") * UNIT).alias("w"))
        return weighed.unionByName(beside).groupBy(*keys, "measure", "bucket").agg(F.sum("w").alias("w"))

    whole = level().withColumn("w", F.col("n") * UNIT).drop("n")
    # joins by name need keys without nulls
    keyed = lambda df, *keys: df.withColumns({f"_{k}": F.concat(F.when(F.col(k).isNull(), "n").otherwise("v"), F.coalesce(F.col(k), F.lit(""))) for k in keys})
    sketch = keyed(sketch, "lang", "source")
    langs = lean(level("_lang"), whole, ["_lang"], [])
    groups = lean(level("_lang", "_source"), langs, ["_lang", "_source"], ["_lang"])
    plain = lambda k: F.when(F.substring(f"_{k}", 1, 1) == "v", F.expr(f"substring(_{k}, 2)")).alias(k)
    return groups.select(plain("lang"), plain("source"), "measure", "bucket", "w")


def percentiles(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, p, top): the percentiles 1 to 99 of every merged sketch."""
    keys = ["lang", "source", "measure"]
    whole = W.partitionBy(*keys)
    running = sketch.select(*keys, bucket_top("bucket").alias("top"), "w", F.sum("w").over(whole.orderBy("bucket")).alias("upto"), F.sum("w").over(whole).alias("size"))
    spread = running.select(*keys, "top", F.expr("100 * (upto - w) div size + 1").alias("first"), F.expr("least(99, 100 * upto div size)").alias("last"))
    return spread.where("first <= last").select(*keys, F.explode(F.sequence("first", "last")).alias("p"), "top")


def thresholds(counted: DataFrame, shrink: int = SHRINK) -> DataFrame:
    """One row per (lang, source): lower and upper limit of each measure, from the percentiles of its merged sketch."""
    keys = ["lang", "source", "measure"]
    whole = W.partitionBy(*keys)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("top"))).over(whole)
    slack = F.coalesce(*[F.when(F.col("measure") == name, F.lit(slack)) for name, (_, _, slack, _) in MEASURES.items()])
    rows = percentiles(merged(sketches(counted), shrink)).select(
        *keys, "p", "top", F.lead("top").over(whole.orderBy("p")).alias("above"), F.lag("top").over(whole.orderBy("p")).alias("below"), at(1).alias("least"), at(50).alias("mid"), at(99).alias("most"), slack.alias("slack"),
    )
    near_up, far_up = F.col("top") - F.col("mid") + F.col("slack"), F.col("above") - F.col("mid") + F.col("slack")
    near_low, far_low = F.col("mid") - F.col("top") + F.col("slack"), F.col("mid") - F.col("below") + F.col("slack")
    jump = lambda near, far, inside: F.max(F.when(inside, F.struct((far / near).alias("ratio"), (-F.abs(F.col("p") - 50)).alias("place"), (near * far).alias("square"))))
    best = rows.groupBy(*keys, "least", "mid", "most", "slack").agg(
        jump(near_up, far_up, (F.col("p") >= 50) & F.col("above").isNotNull()).alias("up"), jump(near_low, far_low, (F.col("p") <= 50) & F.col("below").isNotNull()).alias("low"),
    )
    middle = lambda side: F.sqrt(F.col(f"{side}.square").cast("double"))
    limits = best.select(
        *keys,
        F.when(F.col("up.ratio") >= JUMP, F.col("mid") - F.col("slack") + F.floor(middle("up"))).otherwise(F.col("mid") + FAR * (F.col("most") - F.col("mid")) + F.col("slack")).alias("upper"),
        F.when(F.col("low.ratio") >= JUMP, F.col("mid") + F.col("slack") - F.floor(middle("low"))).otherwise(F.col("mid") - FAR * (F.col("mid") - F.col("least")) - F.col("slack")).alias("lower"),
    )
    per_measure = [F.max(F.when(F.col("measure") == name, F.col("upper"))).alias(f"{name}_upper") for name in MEASURES]
    per_measure += [F.max(F.when(F.col("measure") == name, F.col("lower"))).alias(f"{name}_lower") for name, (*_, both) in MEASURES.items() if both]
    return limits.groupBy("lang", "source").agg(*per_measure)


def judge(docs: DataFrame, shrink: int = SHRINK) -> DataFrame:
    """Counts, base rule, group limits and verdict for every document."""
    counted = staged(document_counts(docs), "quality-counts")
    l = thresholds(counted, shrink).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    joined = counted.join(l, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    fine = F.lit(True)
    for name, (*_, both) in MEASURES.items():
        fine = fine & (measure(name) <= F.col(f"{name}_upper"))
        if both:
            fine = fine & (measure(name) >= F.col(f"{name}_lower"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", F.when(base_failed(), False).otherwise(F.coalesce(fine, F.lit(True))))


def keep_good(docs: DataFrame, shrink: int = SHRINK) -> DataFrame:
    """The documents whose verdict is kept, with their columns; rows that share a doc_id are judged each."""
    kept = judge(docs, shrink).where("kept").select("doc_id", "lang", "source", "text_hash")
    return keep_rows(docs, kept, {"lang": F.col("lang"), "source": F.col("source"), "text_hash": F.xxhash64("text")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


_LIMITS = ", ".join(f"max(upper) filter (where measure = '{m}') as {m}_upper, max(lower) filter (where measure = '{m}') as {m}_lower" for m in MEASURES)
_VALUES = " union all ".join(f"select lang, source, '{m}' as measure, ({num} * {per}) // greatest(n_words, 1) as v from good" for m, (num, per, *_) in MEASURES.items())
_FINE = " and ".join(
    f"({num} * {per}) // greatest(n_words, 1) <= {m}_upper" + (f" and ({num} * {per}) // greatest(n_words, 1) >= {m}_lower" if both else "") for m, (num, per, _, both) in MEASURES.items()
)
_SLACK = "case measure " + " ".join(f"when '{m}' then {slack}" for m, (_, _, slack, _) in MEASURES.items()) + " end"
ORACLE_SQL = f"""
with d as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select doc_id, lang, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d),
pos as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
tri as (select doc_id, i, word, lead(word, 1) over p as w2, lead(word, 2) over p as w3 from pos window p as (partition by doc_id order by i)),
tcount as (select doc_id, i, case when w3 is not null then count(*) over (partition by doc_id, word, w2, w3) else 0 end as times from tri),
cover as (select doc_id, i, greatest(times, coalesce(lag(times, 1) over p, 0), coalesce(lag(times, 2) over p, 0)) as times from tcount window p as (partition by doc_id order by i)),
rep as (select doc_id, count(*) filter (where times >= 2) as n_repeat_words from cover group by doc_id),
line as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from line where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
c as (select w.doc_id, lang, source, len(ws)::bigint as n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join rep using (doc_id) left join dup using (doc_id)),
b as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from c),
good as (select * from b where not base_failed),
vals as ({_VALUES}),
bk as (select lang, source, measure, 64 * greatest(length(bin(v)) - 7, 0) + (v >> greatest(length(bin(v)) - 7, 0)) as bucket from vals),
sk as (select lang, source, measure, bucket, count(*) as n from bk group by all),
wn as (select measure, bucket, sum(n) as n, sum(sum(n)) over (partition by measure) as whole from sk group by measure, bucket),
ln as (select lang, measure, bucket, sum(n) * {UNIT} as w from sk group by lang, measure, bucket
  union all select l.lang, w.measure, w.bucket, ({SHRINK * UNIT} * w.n * {UNIT}) // (w.whole * {UNIT}) from (select distinct lang, measure from sk) l join wn w using (measure)),
lw as (select lang, measure, bucket, sum(w) as w, sum(sum(w)) over (partition by lang, measure) as whole from ln group by lang, measure, bucket),
gn as (select lang, source, measure, bucket, n * {UNIT} as w from sk
  union all select g.lang, g.source, g.measure, l.bucket, ({SHRINK * UNIT} * l.w) // l.whole from (select distinct lang, source, measure from sk) g join lw l on l.measure = g.measure and l.lang is not distinct from g.lang),
gw as (select lang, source, measure, bucket, sum(w)::bigint as w from gn group by lang, source, measure, bucket),
run as (select *, (sum(w) over (partition by lang, source, measure order by bucket))::bigint as upto, (sum(w) over (partition by lang, source, measure))::bigint as size,
  case when bucket < 128 then bucket else ((bucket - 64 * (bucket // 64 - 1) + 1) << (bucket // 64 - 1)::int) - 1 end as top from gw),
pc as (select lang, source, measure, top, unnest(range((100 * (upto - w)) // size + 1, least(99, (100 * upto) // size) + 1)) as p from run),
pr as (select *, lead(top) over (partition by lang, source, measure order by p) as above, lag(top) over (partition by lang, source, measure order by p) as below,
  {_SLACK} as slack,
  max(top) filter (where p = 1) over (partition by lang, source, measure) as least, max(top) filter (where p = 50) over (partition by lang, source, measure) as mid,
  max(top) filter (where p = 99) over (partition by lang, source, measure) as most from pc),
up as (select lang, source, measure, (above - mid + slack)::double / (top - mid + slack) as ratio, (above - mid + slack) * (top - mid + slack) as square,
  row_number() over (partition by lang, source, measure order by (above - mid + slack)::double / (top - mid + slack) desc, p) as k from pr where p >= 50 and above is not null),
low as (select lang, source, measure, (mid - below + slack)::double / (mid - top + slack) as ratio, (mid - below + slack) * (mid - top + slack) as square,
  row_number() over (partition by lang, source, measure order by (mid - below + slack)::double / (mid - top + slack) desc, p desc) as k from pr where p <= 50 and below is not null),
each as (select distinct lang, source, measure, least, mid, most, slack from pr),
pick as (select e.lang, e.source, e.measure,
  case when u.ratio >= {JUMP} then mid - slack + floor(sqrt(u.square::double)) else mid + {FAR} * (most - mid) + slack end as upper,
  case when l.ratio >= {JUMP} then mid + slack - floor(sqrt(l.square::double)) else mid - {FAR} * (mid - least) - slack end as lower
  from each e left join up u on u.k = 1 and u.measure = e.measure and u.lang is not distinct from e.lang and u.source is not distinct from e.source
  left join low l on l.k = 1 and l.measure = e.measure and l.lang is not distinct from e.lang and l.source is not distinct from e.source),
lim as (select lang, source, {_LIMITS} from pick group by lang, source)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else coalesce({_FINE}, true) end as kept
from b left join lim on lim.lang is not distinct from b.lang and lim.source is not distinct from b.source
"""
