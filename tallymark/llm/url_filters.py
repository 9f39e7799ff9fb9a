"""URL filters by a temporal list join (operator 4).

List entries are dated: a key (a host, or a host with a path prefix) is blocked,
allowed or removed from the list at a time. Each key's entries in order of time become
validity intervals [since, until), and every capture is evaluated as of its fetch time
against the entries that were active then.

A URL is looked up under its host, under each parent domain of two labels or more, and
under the host with each of its path prefixes, as deep as the list's keys go. Of the active
entries the most specific key decides (longest path, then longest host); without one
the capture is allowed. A key's entries of equal time: block wins over allow, allow
over remove. ``MAX_HOST`` and ``MAX_PATH`` are the depths that are looked up at least;
a list with deeper keys is looked up to its greatest depth. The host of a key is
lower-cased, its path is taken as written.

The join is an equality on the key with the interval as a residual; intervals of one
key do not overlap, so a look-up gives at most one row, however hot its host is. Look-ups
leave the URL behind: they carry the page, a hash of the capture and its fetch time, and
only those that hit come back. Skew of a hot host on the capture side is split by adaptive
execution.

Defined cases: a null or unparsable URL has no key and is allowed; a null fetch time
sees no entry; entries with null key or time are ignored; ports, user info, a trailing
dot and case of the host do not matter; repeated captures are evaluated each; empty
tables give an empty result; extra columns of captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_HOST = 6
MAX_PATH = 3


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(host, r"\.$", "")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: str, max_host: int = MAX_HOST, max_path: int = MAX_PATH) -> Column:
    """Array of structs (key, rank) under which a URL is looked up; a higher rank is more specific."""
    labels = "split(host, '[.]')"
    parents = (
        f"transform(sequence(2, greatest(2, least({max_host}, size({labels}) - 1))), "
        f"n -> struct(array_join(slice({labels}, greatest(size({labels}) - n + 1, 1), n), '.') as key, n as rank))"
    )
    parents = f"case when size({labels}) > 2 then {parents} else array() end"
    segments = "filter(split(path, '/'), s -> s <> '')"
    paths = (
        f"transform(sequence(1, greatest(1, least({max_path}, size({segments})))), "
        f"n -> struct(concat(host, '/', array_join(slice({segments}, 1, n), '/')) as key, 1000 + n as rank))"
    )
    paths = f"case when size({segments}) > 0 then {paths} else array() end"
    return F.expr(f"case when host is not null then concat(array(struct(host as key, 999 as rank)), {parents}, {paths}) end")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of the dated entries (key, action, listed_at)."""
    host = F.substring_index("key", "/", 1)
    checked = entries.where("key is not null and listed_at is not null").select(F.concat(F.lower(host), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)")).alias("key"), "action", "listed_at")
    order = F.expr("case action when 'block' then 2 when 'allow' then 1 else 0 end")
    one = checked.groupBy("key", "listed_at").agg(F.max(F.struct(order.alias("o"), "action")).alias("a"))
    until = F.lead("listed_at").over(W.partitionBy("key").orderBy("listed_at"))
    spans = one.select("key", F.col("a.action").alias("action"), F.col("listed_at").alias("since"), until.alias("until"))
    return spans.where("action in ('block', 'allow')")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, matched_key, action and allowed of every capture (page_id, url, fetched_at)."""
    labels, segments = F.size(F.split(F.substring_index("key", "/", 1), "[.]")), F.size(F.split("key", "/")) - 1
    deepest = entries.agg(F.max(labels).alias("host"), F.max(segments).alias("path")).first()
    depths = max(MAX_HOST, deepest["host"] or 0), max(MAX_PATH, deepest["path"] or 0)
    # a capture is named by its page and a hash; equal captures share their verdict
    base = captures.select("page_id", "url", "fetched_at", F.xxhash64("url", "fetched_at").alias("capture"))
    looked = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("keys", keys_of("url", *depths))
    asked = looked.select("page_id", "capture", "fetched_at", F.explode("keys").alias("k")).select("page_id", "capture", "fetched_at", "k.key", "k.rank")
    spans = intervals(entries).withColumnRenamed("key", "list_key")
    active = (F.col("key") == F.col("list_key")) & (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    found = asked.join(spans, active).groupBy(F.col("page_id").alias("_page"), F.col("capture").alias("_capture")).agg(F.max(F.struct("rank", "list_key", "action")).alias("best"))
    decided = base.join(found, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("capture") == F.col("_capture")), "left")
    return decided.select("page_id", "url", "fetched_at", F.col("best.list_key").alias("matched_key"), F.col("best.action").alias("action"), (F.coalesce(F.col("best.action"), F.lit("allow")) != "block").alias("allowed"))


def fetch_times(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time; one is derived from page_id: a minute of the year 2024."""
    return pages.select("page_id", "url", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id * 7919 % 527040 as int), 0)").alias("fetched_at"))


def made_list(pages: DataFrame) -> DataFrame:
    """Dated entries for the query: digit 0-5 of md5(key) decides whether and how a key is listed."""
    host = host_of(F.col("url"))
    seg = F.element_at(F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != ""), 1)
    hosts = pages.select(host.alias("host"), F.when(F.size(F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != "")) > 0, seg).alias("seg")).where("host is not null").distinct()
    labels = F.split("host", "[.]")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    keys = hosts.select("host").union(hosts.where("seg is not null").select(F.concat_ws("/", "host", "seg"))).union(hosts.select(domain)).distinct().toDF("key")
    d = F.substring(F.md5("key"), 1, 1)
    day = lambda k: F.conv(F.substring(F.md5("key"), k, 2), 16, 10).cast("int")
    at = lambda k, plus: F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(day(k) % 120 + plus)
    events = F.when(d.isin("0", "1", "2", "3"), F.array(F.struct(F.lit("block").alias("action"), at(3, 0).alias("listed_at")), F.struct(F.lit("remove").alias("action"), at(5, 120).alias("listed_at")), F.struct(F.lit("block").alias("action"), at(7, 240).alias("listed_at"))))
    events = events.when(d.isin("4", "5"), F.array(F.struct(F.lit("allow").alias("action"), at(3, 0).alias("listed_at")), F.struct(F.lit("block").alias("action"), at(5, 120).alias("listed_at"))))
    return keys.select("key", F.explode(events).alias("e")).select("key", "e.action", "e.listed_at")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return evaluate(fetch_times(pages), made_list(pages)).select("page_id", "url", "fetched_at", "matched_key", "action", "allowed")


_DAY = "(('0x' || substr(md5(key), {k}, 2))::int % 120 + {plus})"
_AT = "timestamp '2024-01-01 00:00:00' + to_days(" + _DAY + ")"
ORACLE_SQL = f"""
with p as (select page_id, url, timestamp '2024-01-01 00:00:00' + to_minutes(page_id * 7919 % 527040) as fetched_at,
  nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\\.$', '')), '') as host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') as segs from pages),
q as (select *, string_split(host, '.') as labels from p),
keys as (select distinct key from (
  select host as key from q where host is not null union all
  select host || '/' || segs[1] from q where host is not null and len(segs) > 0 union all
  select array_to_string(labels[greatest(len(labels) - 1, 1):], '.') from q where host is not null)),
ev as (
  select key, 'block' as action, {_AT.format(k=3, plus=0)} as t from keys where substr(md5(key), 1, 1) in ('0','1','2','3') union all
  select key, 'remove', {_AT.format(k=5, plus=120)} from keys where substr(md5(key), 1, 1) in ('0','1','2','3') union all
  select key, 'block', {_AT.format(k=7, plus=240)} from keys where substr(md5(key), 1, 1) in ('0','1','2','3') union all
  select key, 'allow', {_AT.format(k=3, plus=0)} from keys where substr(md5(key), 1, 1) in ('4','5') union all
  select key, 'block', {_AT.format(k=5, plus=120)} from keys where substr(md5(key), 1, 1) in ('4','5')),
iv as (select key, action, t as since, lead(t) over (partition by key order by t) as until from ev),
ask as (select page_id, url, fetched_at, host as key, 999 as rank from q where host is not null
  union all select page_id, url, fetched_at, array_to_string(labels[len(labels) - n + 1:], '.'), n from q, range(2, {MAX_HOST + 1}) r(n) where n < len(labels)
  union all select page_id, url, fetched_at, host || '/' || array_to_string(segs[1:n], '/'), 1000 + n from q, range(1, {MAX_PATH + 1}) r(n) where host is not null and n <= len(segs)),
hit as (select page_id, max_by(iv.key, rank) as matched_key, max_by(action, rank) as action from ask join iv on iv.key = ask.key and action <> 'remove' and since <= fetched_at and (until is null or fetched_at < until) group by page_id)
select p.page_id, url, fetched_at, matched_key, action, coalesce(action, 'allow') <> 'block' as allowed from p left join hit using (page_id)
"""
