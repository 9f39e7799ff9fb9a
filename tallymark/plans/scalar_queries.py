"""Scalar functions over the fixtures (SC1-SC38)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions import udfs as U
from ..sources import fixtures as X
from .base import query

STAMP = "case event_id % 7 when 0 then lpad((t_sec // 60)::varchar, 2, '0') || ':' || lpad((t_sec % 60)::varchar, 2, '0') when 1 then '1:02:' || lpad((t_sec % 60)::varchar, 2, '0') when 2 then t_sec || 's' when 3 then t_sec || '.5s' when 4 then t_sec::varchar when 5 then 'abc' else 'at 0' || (t_sec % 10) || ':3' || (t_sec % 10) || ' or so' end"
STAMPS = f"st as (select event_id, t_sec, {STAMP} as t from fx_base)"
CLOCK = "case when len(string_split(trim(t), ':')) = 2 then try_cast(string_split(trim(t), ':')[1] as double) * 60 + try_cast(string_split(trim(t), ':')[2] as double) when len(string_split(trim(t), ':')) = 3 then try_cast(string_split(trim(t), ':')[1] as double) * 3600 + try_cast(string_split(trim(t), ':')[2] as double) * 60 + try_cast(string_split(trim(t), ':')[3] as double) end"
BARE = "try_cast(nullif(regexp_extract(trim(t), '^([0-9]+(?:\\.[0-9]+)?)\\s*s?$', 1), '') as double)"


def stamps(spark, d):
    two = lambda e: f"lpad(cast({e} as string), 2, '0')"
    return X.base(spark, d).selectExpr("event_id", "t_sec", f"case event_id % 7 when 0 then concat({two('t_sec div 60')}, ':', {two('t_sec % 60')}) when 1 then concat('1:02:', {two('t_sec % 60')}) when 2 then concat(t_sec, 's') when 3 then concat(t_sec, '.5s') when 4 then cast(t_sec as string) when 5 then 'abc' else concat('at 0', t_sec % 10, ':3', t_sec % 10, ' or so') end as t")


@query("sc1_clock_seconds", f"with {STAMPS} select event_id, {CLOCK} as seconds from st", fx=True)
def sc1_clock_seconds(spark, d):
    return stamps(spark, d).select("event_id", C.clock_seconds(F.col("t")).alias("seconds"))


@query("sc2_lenient_seconds", f"with {STAMPS} select event_id, coalesce({CLOCK}, {BARE}) as seconds from st", fx=True)
def sc2_lenient_seconds(spark, d):
    return stamps(spark, d).select("event_id", C.lenient_seconds(F.col("t")).alias("seconds"))


@query("sc3_strict_seconds", f"with {STAMPS} select event_id, case when regexp_matches(t, '^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$') then {CLOCK} end as seconds from st", fx=True)
def sc3_strict_seconds(spark, d):
    return stamps(spark, d).select("event_id", C.strict_seconds(F.col("t")).alias("seconds"))


@query("sc4_clock_text", "select event_id, printf('%02d:%02d', floor(value)::bigint // 60, floor(value)::bigint % 60) as truncated, printf('%02d:%02d', round(value)::bigint // 60, round(value)::bigint % 60) as rounded from fx_base", fx=True)
def sc4_clock_text(spark, d):
    v = F.col("value")
    return X.base(spark, d).select("event_id", C.clock(v).alias("truncated"), C.clock(v, rounding=True).alias("rounded"))


@query("sc5_first_clock", f"with {STAMPS} select event_id, coalesce(nullif(regexp_extract(t, '[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?'), ''), t) as t from st", fx=True)
def sc5_first_clock(spark, d):
    return stamps(spark, d).select("event_id", C.first_clock(F.col("t")).alias("t"))


@query("sc6_shifted_clock", f"with {STAMPS}, s as (select event_id, t, coalesce({CLOCK}, {BARE}) + 28 * (event_id % 5) as s from st) select event_id, coalesce(printf('%02d:%02d', floor(s)::bigint // 60, floor(s)::bigint % 60), t) as t from s", fx=True)
def sc6_shifted_clock(spark, d):
    return stamps(spark, d).select("event_id", C.shifted_clock(F.col("t"), F.expr("28D * (event_id % 5)")).alias("t"))


@query("sc7_chunk_border", "select event_id, value % 28 <= 0.5 or 28 - value % 28 <= 0.5 as at_border from fx_base", fx=True)
def sc7_chunk_border(spark, d):
    return X.base(spark, d).select("event_id", C.at_chunk_border(F.col("value")).alias("at_border"))


WIRE_ROW = "'{\"f\":\"' || category || '\",\"t\":\"' || t_sec || '\",\"c\":' || coalesce(confidence::varchar, 'null') || '}'"
WIRES = f"wire as (select event_id, category, case event_id % 5 when 0 then '{{\"d\":[' || row_ || ']}}' when 1 then '```json' || chr(10) || '{{\"d\":[' || row_ || ']}}' || chr(10) || '```' when 2 then '[' || row_ || ',' || row_ || ']' when 3 then '{{\"other\":1}}' else 'no json' end as raw from (select *, {WIRE_ROW} as row_ from fx_base))"
FLAG = "array<struct<f: string, t: string, c: double>>"


def wires(spark, d):
    row = F.concat(F.lit('{"f":"'), "category", F.lit('","t":"'), F.col("t_sec").cast("string"), F.lit('","c":'), F.coalesce(F.col("confidence").cast("string"), F.lit("null")), F.lit("}"))
    raw = F.expr("case event_id % 5 when 0 then concat('{\"d\":[', r, ']}') when 1 then concat('```json\n{\"d\":[', r, ']}\n```') when 2 then concat('[', r, ',', r, ']') when 3 then '{\"other\":1}' else 'no json' end")
    return X.base(spark, d).withColumn("r", row).select("event_id", "category", raw.alias("raw"))


@query("sc10_wire_flags", f"with {WIRES} select event_id, case event_id % 5 when 0 then 1 when 1 then 1 when 2 then 2 else 0 end as n_flags, case when event_id % 5 < 3 then category end as first_category from wire", fx=True)
def sc10_wire_flags(spark, d):
    flags = C.wire_flags(F.col("raw"), FLAG)
    return wires(spark, d).select("event_id", flags.alias("d")).select("event_id", F.size("d").alias("n_flags"), F.get("d", F.lit(0)).getField("f").alias("first_category"))


@query("sc8_lenient_json", f"select event_id, case event_id % 5 when 2 then '[' || row_ || ',' || row_ || ']' when 3 then '{{\"other\":1}}' when 4 then null else '{{\"d\":[' || row_ || ']}}' end as value from (select *, {WIRE_ROW} as row_ from fx_base)", fx=True)
def sc8_lenient_json(spark, d):
    w = wires(spark, d).withColumn("raw", F.concat("raw", F.lit(" trailing words")))
    return w.select("event_id", U.lenient_json("raw").alias("value"))


@query("sc9_artifact_repair", "select event_id, '{\"t\": \"' || t_sec || '\"}' as fixed from fx_base", fx=True)
def sc9_artifact_repair(spark, d):
    broken = F.concat(F.lit('{"box_2d": ['), F.col("t_sec").cast("string"), F.lit('"}'))
    return X.base(spark, d).select("event_id", C.repaired(broken).alias("fixed"))


TURNS = "select conv_id, list({'t': turn * 15, 'text': text} order by turn) as segs from conversations group by 1"


def transcripts(spark, d):
    """Transcripts of conversations: a turn is a segment that begins every 15 s."""
    t = X.table(spark, d, "conversations")
    segs = F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") * 15).alias("t"), "text"))).alias("segs")
    return t.groupBy("conv_id").agg(segs)


@query("sc13_transcript_summary", f"with c as ({TURNS}) select conv_id, array_to_string(list_transform(segs, lambda s: s.text), ' ') as full_text, segs[-1].t::double as end_s, (conv_id % 90 + 15.0 * len(segs) - segs[-1].t) > greatest(15.0, 0.1 * (conv_id % 90 + 15.0 * len(segs))) as incomplete from c")
def sc13_transcript_summary(spark, d):
    t = transcripts(spark, d).withColumn("end_s", F.element_at("segs", -1)["t"].cast("double")).withColumn("duration", F.expr("conv_id % 90 + 15D * size(segs)"))
    return t.select("conv_id", F.array_join(F.transform("segs", lambda s: s["text"]), " ").alias("full_text"), "end_s", C.incomplete(F.col("duration"), F.col("end_s")).alias("incomplete"))


@query("sc14_line_rendering", f"with c as ({TURNS}) select conv_id, array_to_string(list_transform(segs, lambda s: '[' || printf('%02d:%02d', s.t // 60, s.t % 60) || '] ' || s.text), chr(10)) as lines from c")
def sc14_line_rendering(spark, d):
    return transcripts(spark, d).select("conv_id", F.array_join(F.transform("segs", lambda s: F.concat(F.lit("["), C.clock(s["t"]), F.lit("] "), s["text"])), "\n").alias("lines"))


@query("sc15_normal_text", "select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[?\\s*inaudible\\s*\\]?', ' ', 'gi'), '\\p{P}', ' ', 'g'), '\\s+', ' ', 'g')) as text from documents where regexp_full_match(text, '[\\x01-\\x7f]*')")
def sc15_normal_text(spark, d):
    docs = X.table(spark, d, "documents").where(F.regexp_like("text", F.lit(r"^[\x01-\x7f]*$")))
    return docs.select("doc_id", C.normal_text(F.col("text")).alias("text"))


@query("sc17_collapse_repeats")
def sc17_collapse_repeats(spark, d):
    return X.table(spark, d, "documents").select("doc_id", U.collapse_repeats("text").alias("text"))


@query("sc18_text_ratio")
def sc18_text_ratio(spark, d):
    b = X.table(spark, d, "benchmark")
    return b.select("item_id", U.text_ratio("text", F.reverse("text")).alias("ratio"))


@query("sc20_time_decay", "select event_id, case when event_id % 4 > 0 then exp(-(t_sec % 60) / 20.0::double) else 0.7 end as decay from fx_base", fx=True)
def sc20_time_decay(spark, d):
    return X.base(spark, d).select("event_id", C.time_decay(F.col("t_sec") % 60, F.col("event_id") % 4 > 0).alias("decay"))


@query("sc21_tenth_bin", "with v as (select event_id, (event_id % 18) / 10.0::double as v from fx_base) select event_id, case when v >= 1.5 then '1.5+' else printf('%.1f-%.1f', trunc(v / 0.1::double) / 10, (trunc(v / 0.1::double) + 1) / 10) end as bin from v", fx=True)
def sc21_tenth_bin(spark, d):
    return X.base(spark, d).select("event_id", C.tenth_bin(F.expr("(event_id % 18) / 10.0D")).alias("bin"))


@query("sc22_decile_bucket", "select event_id, case when confidence is null then 'missing' when confidence >= 0.9 then '0.9-1.0' else printf('%.1f-%.1f', floor(round(confidence * 100) / 10) / 10, (floor(round(confidence * 100) / 10) + 1) / 10) end as bucket from fx_base", fx=True)
def sc22_decile_bucket(spark, d):
    from ..operators.confusion import decile_of

    return X.base(spark, d).select("event_id", decile_of(F.col("confidence")).alias("bucket"))


@query("sc24_short_id", "select distinct file_id || '_x_' || user_id as long_id, 'x' as short_id from fx_base", fx=True)
def sc24_short_id(spark, d):
    long = X.base(spark, d).select(F.concat_ws("_", "file_id", F.lit("x"), F.col("user_id").cast("string")).alias("long_id")).distinct()
    return long.select("long_id", C.short_id(F.col("long_id")).alias("short_id"))


#: CRC-32 bit by bit
CRC32 = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(file_id, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"


@query("sc27_stable_shard", f"select file_id, ({CRC32} % 4)::bigint as shard from (select distinct file_id from fx_base)", fx=True)
def sc27_stable_shard(spark, d):
    return X.base(spark, d).select("file_id").distinct().select("file_id", (F.crc32(F.col("file_id").cast("binary")) % 4).alias("shard"))


@query("sc29_geometric_confidence", "select event_id, sqrt(exp(-(event_id % 30) / 10.0::double) * exp(-(event_id % 7) / 5.0::double)) as confidence from fx_base", fx=True)
def sc29_geometric_confidence(spark, d):
    return X.base(spark, d).select("event_id", C.geometric_confidence(F.expr("-(event_id % 30) / 10.0D"), F.expr("-(event_id % 7) / 5.0D")).alias("confidence"))


@query("sc30_top_k_entropy", "with p as (select event_id, [exp(-0.1 - (event_id % 5)), exp(-1.0 - (event_id % 3)), exp(-2.0)] as p from fx_base), q as (select event_id, list_transform(p, lambda x: x / list_sum(p)) as q from p) select event_id, -list_sum(list_transform(q, lambda x: x * ln(x))) as entropy from q", fx=True)
def sc30_top_k_entropy(spark, d):
    return X.base(spark, d).select("event_id", C.entropy(F.expr("array(-0.1D - (event_id % 5), -1.0D - (event_id % 3), -2.0D)")).alias("entropy"))


@query("sc32_yes_probability", "select event_id, case event_id % 4 when 0 then exp(-0.2::double) when 1 then exp(-2.5::double) when 2 then 1 - exp(-0.2::double) end as p_yes from fx_base", fx=True)
def sc32_yes_probability(spark, d):
    b = X.base(spark, d)
    token = F.expr("case event_id % 4 when 0 then ' Yes' when 1 then 'no' when 2 then 'no' else 'maybe' end")
    top = F.expr("case when event_id % 4 = 1 then array(named_struct('token', 'no', 'logprob', -0.2D), named_struct('token', ' yes', 'logprob', -2.5D)) else array(named_struct('token', 'x', 'logprob', -9D)) end")
    return b.select("event_id", C.yes_probability(token, F.lit(-0.2), top).alias("p_yes"))


@query("sc33_missing_fields", "select file_id, count(*) filter (where confidence is null) as confidence, count(*) filter (where speech_act is null) as speech_act, count(*) filter (where violation is null) as violation from fx_scored group by 1", fx=True)
def sc33_missing_fields(spark, d):
    flags = X.model_flags(X.base(spark, d))
    return flags.groupBy("file_id").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("confidence", "speech_act", "violation")])


@query("sc34_window_text", "select a.conv_id, a.turn, string_agg(b.text, ' ' order by b.turn) as text from conversations a join conversations b on a.conv_id = b.conv_id and abs(a.turn - b.turn) * 15 <= 30 group by 1, 2")
def sc34_window_text(spark, d):
    """The words within 30 s of each turn, in one pass over the turns in order of time."""
    t = X.table(spark, d, "conversations").withColumn("at", F.col("turn") * 15)
    near = W.partitionBy("conv_id").orderBy("at").rangeBetween(-30, 30)
    return t.select("conv_id", "turn", F.array_join(F.collect_list("text").over(near), " ").alias("text"))


@query("sc34_fixed_windows", "select conv_id, (turn * 15) // 45 as win, string_agg(text, ' ' order by turn) as text from conversations group by 1, 2")
def sc34_fixed_windows(spark, d):
    t = X.table(spark, d, "conversations").withColumn("win", F.expr("(turn * 15) div 45"))
    return t.groupBy("conv_id", "win").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("text"))


@query("sc37_placeholders", "select item_id, 'ID ' || item_id || ' TEXT ' || substr(text, 1, 20) as prompt from benchmark")
def sc37_placeholders(spark, d):
    b = X.table(spark, d, "benchmark")
    return b.select("item_id", F.replace(F.replace(F.lit("ID {id} TEXT {text}"), F.lit("{id}"), F.col("item_id").cast("string")), F.lit("{text}"), F.substring("text", 1, 20)).alias("prompt"))


