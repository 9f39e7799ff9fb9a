"""Registration of queries with the SQL that checks them, and the SQL form of the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The fixture tables of ``tallymark.sources.fixtures`` as common table expressions.
FX = """
fx_base as (
  select event_id, user_id, 'call_' || user_id as file_id,
    case user_id % 5 when 0 then 'hindi' when 1 then 'tamil' when 2 then 'telugu' when 3 then 'kannada' else 'malayalam' end as language,
    case event_type when 'click' then 'PlatformMove' when 'purchase' then 'SuspiciousActivity' when 'view' then 'Explicit-Flirting' when 'error' then 'PlatformMove' else 'Not a violation' end as category,
    cast(floor(((extract(day from ts) - 1) * 86400 + extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts))) / 4320.0) as int) as t_sec,
    case when event_id % 10 = 9 then null else cast(json_extract_string(props, '$.k') as double) / 100.0 end as confidence,
    case when event_id % 17 = 0 then null else (event_id % 101) / 101.0 end as logprob_confidence,
    case when event_id % 19 = 0 then null else (event_id % 41) / 10.0 end as entropy_mean, value, ts
  from events),
fx_gt as (select * from fx_base where event_id % 8 = 0 and user_id % 2 = 0 and category <> 'Not a violation'),
fx_pairs as (
  select f.event_id as mi, g.event_id as gi, g.category as gc,
    row_number() over (partition by f.event_id order by (g.category <> f.category)::int, abs(g.t_sec - f.t_sec), g.event_id) as of_flag,
    row_number() over (partition by g.event_id, f.event_id % 8 order by (g.category <> f.category)::int, abs(g.t_sec - f.t_sec), f.event_id) as of_gt
  from fx_base f join fx_gt g on g.file_id = f.file_id and abs(g.t_sec - f.t_sec) <= 60 where f.event_id % 8 in (1, 2, 3)),
fx_flags as (
  select f.*, 'm' || (event_id % 8) as run_key, case event_id % 8 when 1 then 'v3' when 2 then 'v4' else 'v6' end as prompt,
    h.gi as matched_gi, h.gi is not null as matched, h.gc as matched_gt_category,
    case event_id % 7 when 0 then 'reported' when 1 then 'denial' when 2 then 'hypothetical' when 3 then null else 'direct' end as speech_act,
    case when event_id % 11 = 0 then 'no' when event_id % 11 = 1 then null else 'yes' end as violation,
    case event_id % 13 when 0 then 'unclear' when 1 then 'user' else 'expert' end as speaker,
    case event_id % 9 when 0 then 'DUPLICATE_OR_EXTRA_INSTANCE' when 1 then 'GT_MISS' when 2 then 'MATCHER_MISS' when 3 then 'UNCLEAR' when 4 then 'HALLUCINATED_QUOTE' else null end as fp_mark
  from fx_base f left join fx_pairs h on h.mi = f.event_id and h.of_flag = 1 and h.of_gt = 1 where event_id % 8 in (1, 2, 3)),
fx_scored as (select *, case when not matched then fp_mark end as fp_type from fx_flags),
fx_files as (select run_key, file_id, language, user_id from (select distinct file_id, language, user_id from fx_base) cross join (values ('m1'), ('m2'), ('m3')) r(run_key)),
fx_segments as (select distinct file_id, 60 + user_id * 7 % 541 as duration_s, case when user_id % 23 = 0 then null else user_id * 13 % 97 end as snr_db from fx_base)
"""


def query(name: str, sql: str | None = None, fx: bool = False) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame; ``fx`` puts the fixture tables before the SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            SQL[name] = f"with {FX.strip()}{', ' + text[5:] if text.lower().startswith('with ') else ' ' + text}" if fx else text
        return f

    return register
