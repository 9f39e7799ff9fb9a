"""Merges that are kept on disk, directory trees that are listed and recordings that are decoded (IO1, IO2, IO10, IO11, IO19, E9, SC38)."""

from __future__ import annotations

import io as io_
import os
import uuid
import wave
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import documents as D
from ..operators import scoring as S
from ..sources import audio as A
from ..sources import documents as R
from ..sources import fixtures as X
from ..sources import io
from ..sources.staging import shared_folder
from ..sources.versions import VersionedTable
from .base import query
from .confusion_queries import MODES, tables
from .document_queries import PATH_PARTS
from .named_queries import FILES, TREE


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def schema(spark, ddl):
    return StructType.fromDDL(ddl)


@query("io10_merged_on_disk", "select run_key, file_id, event_id, 'old' as origin from fx_scored where run_key <> 'm2' union all select run_key, file_id, event_id, 'new' from fx_scored where run_key = 'm2' and event_id % 2 = 0", fx=True)
def io10_merged_on_disk(spark, d):
    """A second load replaces one run and leaves the other runs' files alone; the same load again changes nothing."""
    flags = tables(spark, d)[2].select("run_key", "file_id", "event_id")
    kept = VersionedTable(spark, new_folder(spark, "merged"), schema(spark, "run_key string, file_id string, event_id long, origin string"))
    kept.merge(flags.withColumn("origin", F.lit("old")), ["run_key"], "first load")
    new = flags.where("run_key = 'm2' and event_id % 2 = 0").withColumn("origin", F.lit("new"))
    for _ in range(2):
        kept.merge(new, ["run_key"], "second load")
    return kept.read()


@query("io11_annotated_on_disk", "with n as (select run_key, file_id, count(*) as n, count(*) filter (where event_id % 50 <> 1) as m from fx_scored group by 1, 2) select s.run_key, s.file_id, s.event_id, case when n = m then event_id % 3 end as note from fx_scored s join n using (run_key, file_id)", fx=True)
def io11_annotated_on_disk(spark, d):
    """Notes written back into the flags of the files in which every flag has one."""
    flags = tables(spark, d)[2].select("run_key", "file_id", "event_id")
    kept = VersionedTable(spark, new_folder(spark, "annotated"), schema(spark, "run_key string, file_id string, event_id long, note long"))
    kept.merge(flags.withColumn("note", F.lit(None).cast("long")), ["run_key"], "flags")
    notes = flags.where("event_id % 50 <> 1").withColumn("note", F.col("event_id") % 3)
    kept.annotate(notes, ["run_key", "file_id", "event_id"], ["note"], "notes")
    return kept.read()


@query("e9_scored_on_disk", f"with {MODES}, w as (select event_id, max(score) filter (where mode = 'raw') as raw, max(score) filter (where mode = 'sa') as sa, max(score) filter (where mode = 'pp_full') as pp_full from modes group by 1) select run_key, event_id, case when run_key <> 'm3' then raw end as raw, case when run_key <> 'm3' then sa end as sa, case when run_key <> 'm3' then pp_full end as pp_full, case when run_key <> 'm3' then 'modes-1' end as scored_version from fx_scored join w using (event_id)", fx=True)
def e9_scored_on_disk(spark, d):
    """The map of scores by mode, kept with its version's tag in the flags of the runs scored so far."""
    flags = tables(spark, d)[2]
    kept = VersionedTable(spark, new_folder(spark, "scored"), schema(spark, "run_key string, file_id string, event_id long, scored map<string,double>, scored_version string"))
    kept.merge(flags.select("run_key", "file_id", "event_id", F.lit(None).cast("map<string,double>").alias("scored"), F.lit(None).cast("string").alias("scored_version")), ["run_key"], "flags")
    marked = S.with_modes(flags.where("run_key <> 'm3'"))
    scores = F.map_from_arrays(F.array(*map(F.lit, S.MODES)), F.array(*[F.col(f"score_{m}") for m in S.MODES]))
    kept.annotate(marked.select("run_key", "file_id", "event_id", scores.alias("scored"), F.lit("modes-1").alias("scored_version")), ["run_key", "file_id", "event_id"], ["scored", "scored_version"], "modes-1")
    return kept.read().select("run_key", "event_id", *[F.col("scored").getItem(m).alias(m) for m in ("raw", "sa", "pp_full")], "scored_version")


def laid_out(spark, d, exprs, top, content=lambda row: b"-"):
    """A file for every path that the fixture's files have under ``top``, in a folder of this call; the tasks write them. Spark passes over files without content."""
    root = urlparse(new_folder(spark, "tree"))
    if root.scheme not in ("", "file"):
        raise ValueError("the fixture's tree of plain files needs a shared folder that is mounted (file://)")
    paths = X.base(spark, d).select("file_id", "user_id", "language").distinct().select("user_id", F.explode(F.array(*map(F.expr, exprs))).alias("path"))
    folder = root.path

    def write(rows):
        for row in rows:
            path = folder + row["path"].removeprefix(top)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as file:
                file.write(content(row))

    paths.foreachPartition(write)
    return "file://" + folder


def from_root(root):
    return F.replace("path", F.lit(root.replace("file:///", "file:/")), F.lit(""))


LISTED = f"""select file_id, replace({TREE[0]}, '/root', '') as path, language, 'platform' as category, 'TP' as original_bucket, case user_id % 2 when 0 then 'Single' else 'Multi' end as multiplicity from f
union all select file_id, replace({TREE[1]}, '/root', ''), language, 'platform', 'FP', null from f where user_id % 5 <> 2 union all select file_id, replace({TREE[2]}, '/root', ''), language, null, 'FN', null from f"""


@query("io1_listed_tree", f"with {FILES} {LISTED}", fx=True)
def io1_listed_tree(spark, d):
    """A tree of files laid out from the events and listed."""
    root = laid_out(spark, d, TREE, "/root")
    return io.dataset_files(spark, root).withColumn("path", from_root(root))


@query("io1_listed_part", f"with {FILES}, t as ({LISTED}) select * from t where language in ('hindi', 'tamil') and original_bucket in ('TP', 'FN')", fx=True)
def io1_listed_part(spark, d):
    """The same tree, of which only the folders of two languages and two buckets are listed."""
    root = laid_out(spark, d, TREE, "/root")
    return io.dataset_files(spark, root, ["hindi", "tamil"], ["TP", "FN"]).withColumn("path", from_root(root))


POOLED = " union all ".join(f"select replace({e}, '/data', '') as path, {i} as kind, * from f" for i, e in enumerate(PATH_PARTS))


@query("io2_listed_pool", f"""with {FILES}, p as ({POOLED}) select case kind when 0 then file_id || '.MP3' when 1 then file_id || '.wav' else file_id || '.mp3' end as file_id, path, case when kind < 2 then language end as language, case kind when 0 then 'PlatformMove' when 1 then 'Explicit-Flirting' end as category,
 case kind when 0 then 'TP' when 1 then case user_id % 2 when 0 then 'FP' else 'FN' end else 'TN' end as outcome, case when kind = 0 then case user_id % 3 when 0 then 'single' when 1 then 'multi' end end as multiplicity
from p where (kind = 0 and user_id % 3 < 2 and user_id % 7 <> 3) or kind = 1 or (kind = 2 and user_id % 5 <> 2)""", fx=True)
def io2_listed_pool(spark, d):
    """The older layout, with one pool of clean files, laid out and listed."""
    root = laid_out(spark, d, PATH_PARTS, "/data")
    return R.pooled_layout(io.listed(spark, [root]), io.AUDIO).withColumn("path", from_root(root))


WAV_RATE = 1600
#: sample i of user u's recording, and how many it has, in an SQL that both engines read
SAMPLE, SAMPLES = "((i * 37 + user_id * 11) % 201 - 100) * (20 + 130 * (i // 400 % 2))", "1600 + user_id * 37 % 1600"


def wav_of(row):
    u = row["user_id"]
    i = np.arange(1600 + u * 37 % 1600)
    made = io_.BytesIO()
    with wave.open(made, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(WAV_RATE)
        w.writeframes((((i * 37 + u * 11) % 201 - 100) * (20 + 130 * (i // 400 % 2))).astype("<i2").tobytes())
    return made.getvalue() if u % 10 != 7 else b"no recording"


def recorded(spark, d):
    """A recording for every file of the fixture, one in ten of them broken."""
    return A.recordings(spark, [laid_out(spark, d, ["concat('/', language, '/', file_id, '.wav')"], "", wav_of)])


def file_of():
    return F.regexp_extract("path", r"([^/]+)\.wav$", 1)


PCM = f"f as (select distinct file_id, user_id from fx_base), s as (select file_id, user_id, i, {SAMPLE} / 32768.0::double as x from (select *, unnest(range(0, {SAMPLES})) as i from f) where user_id % 10 <> 7)"


@query("io19_decoded_chunks", f"with {PCM} select file_id, (i // 800)::int as chunk, (i // 800) * 0.5::double as offset_s, count(*) as n_samples, max(abs(x)) as peak, sum(x * x) as energy, false as failed from s group by 1, 2, 3 union all select file_id, null, null, null, null, null, true from f where user_id % 10 = 7", fx=True)
def io19_decoded_chunks(spark, d):
    """Recordings decoded and cut into windows of half a second; a file that cannot be decoded keeps a row."""
    c = A.chunks(recorded(spark, d), 0.5, WAV_RATE)
    squares = F.aggregate("samples", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    return c.select(file_of().alias("file_id"), "chunk", "offset_s", F.when(F.col("samples").isNotNull(), F.size("samples").cast("long")).alias("n_samples"), F.array_max(F.transform("samples", F.abs)).cast("double").alias("peak"), squares.alias("energy"), F.col("error").isNotNull().alias("failed"))


@query("sc38_recorded_snr", f"with {PCM}, r as (select file_id, i // 51 as frame, 20 * log10(sqrt(avg(x * x) + 1e-12) + 1e-12) as db from s group by 1, 2 having count(*) = 51), t as (select file_id, quantile_cont(db, 0.1) as lo, quantile_cont(db, 0.9) as hi from r group by 1 having count(*) >= 10) select file_id, round(lo, 6) as noise_floor_db, round(hi, 6) as speech_level_db, round(hi - lo, 6) as snr_db from f left join t using (file_id)", fx=True)
def sc38_recorded_snr(spark, d):
    """Noise floor, speech level and their distance from the recordings themselves; blank for those that cannot be decoded."""
    found = A.levels(recorded(spark, d), WAV_RATE).withColumn("file_id", file_of())
    t = D.snr_table(found, found.where("error is null"), "file_id")
    return t.select("file_id", *[F.round(c, 6).alias(c) for c in ("noise_floor_db", "speech_level_db", "snr_db")])
