"""Result documents on disk, derived from the ``events`` table, for the readers to read."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clock
from . import fixtures as X
from .staging import made_from, shared_folder

_written: set[str] = set()

#: Parts of the fixture in an SQL that both engines read; u is user_id, k the chunk's seconds.
GT_STATUS = {"status": "u % 17 <> 3", "transcript": "u % 11 <> 3", "classification": "u % 13 <> 5"}
MODEL_OK = "u % 7 <> 2"
ASR = {
    "ok": "(u + k) % 9 <> 0", "measured": "u % 10 <> 4", "wer": "case when u % 14 = 6 then null else cast((u * 7 + k) % 17 as double) / cast(10 as double) end", "words": "50 + u % 40",
    "cer": "case when u % 15 = 8 then null else cast((u * 5 + k) % 13 as double) / cast(10 as double) end", "chars": "300 + u % 90", "borders": "u % 6", "corrupted": "least(u % 6, u % 3)",
    "excerpts": "u % 5", "preserved": "least(u % 5, u % 4)", "rtf": "cast(u % 20 as double) / cast(100 as double)",
}
SEMANTIC = {"there": "u % 4 <> 3", "ok": "u % 16 <> 9", "value": "case when u % 12 = 5 then null else cast((u * 3 + k) % 11 as double) / cast(10 as double) end", "words": "50 + u % 40", "affected": "(u * 3 + k) % 11"}
SOURCES, CHUNKS = ["conformer", "core"], [5, 10]
FULL_TEXT = "case when u % 8 = 1 then '' else concat('reference ', file_id) end"


def of(e: str, k: str = "chunk_seconds") -> F.Column:
    """A fixture expression over user_id and a chunk size."""
    return F.expr(sql(e, k))


def sql(e: str, k: str = "chunk_seconds") -> str:
    import re

    return re.sub(r"\bk\b", k, re.sub(r"\bu\b", "user_id", e))


def _status(e: str) -> F.Column:
    return F.when(of(e), "success").otherwise("error")


def gt_documents(b: DataFrame) -> DataFrame:
    g = X.gt_flags(b)
    flag = F.struct("event_id", F.col("category").alias("f"), F.concat(F.lit("about "), clock(F.col("t_sec")), F.lit(" in")).alias("t"), F.lit("native").alias("tr"), F.lit("english").alias("vb"), F.lit("why").alias("j"), F.col("confidence").alias("c"), F.col("t_sec").alias("sec"), F.col("event_id").alias("id"))
    flags = g.groupBy("file_id").agg(F.array_sort(F.collect_list(flag)).alias("d"))
    segments = F.transform(F.sequence(F.lit(0), (F.col("user_id") % 4).cast("int")), lambda i: F.struct(clock(i * 15).alias("t"), F.concat(F.lit("line "), i.cast("string")).alias("text")))
    files = b.select("file_id", "language", "user_id").distinct().join(flags, "file_id", "left")
    return files.select(
        "file_id", "language", "user_id", _status(GT_STATUS["status"]).alias("status"), F.when(of(GT_STATUS["status"]), None).otherwise("no reply").alias("error"),
        F.struct(_status(GT_STATUS["transcript"]).alias("status"), segments.alias("segments"), of(FULL_TEXT).alias("full_text"), (F.col("user_id") % 9 == 1).alias("incomplete_transcript")).alias("transcript"),
        F.struct(_status(GT_STATUS["classification"]).alias("status"), F.coalesce(F.transform("d", lambda x: x.dropFields("event_id")), F.array()).alias("d")).alias("classification"),
    )


def model_documents(b: DataFrame) -> DataFrame:
    flags = X.model_flags(b)
    flag = F.struct(F.col("event_id").alias("id"), "category", clock(F.col("t_sec")).alias("t"), "confidence", F.col("logprob_confidence"), F.struct(F.col("entropy_mean").alias("mean")).alias("entropy"), "speech_act", "violation")
    listed = flags.groupBy("run_key", "file_id").agg(F.array_sort(F.collect_list(flag)).alias("flags"))
    seconds = F.when(F.col("user_id") % 3 == 0, None).otherwise((F.col("user_id") % 30 + 1).cast("double"))
    return X.files(b).join(listed, ["run_key", "file_id"], "left").select("run_key", "file_id", "language", "user_id", _status(MODEL_OK).alias("status"), F.when(of(MODEL_OK), None).otherwise("timeout").alias("error"), seconds.alias("inference_time_sec"), F.coalesce("flags", F.array()).alias("flags"))


def _per_source(b: DataFrame) -> DataFrame:
    every = lambda values, kind: F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind}>"))
    return b.select("file_id", "language", "user_id").distinct().select("*", every(SOURCES, "string").alias("source")).select("*", every(CHUNKS, "bigint").alias("chunk_seconds"))


def asr_documents(b: DataFrame) -> DataFrame:
    e = {n: of(x) for n, x in ASR.items()}
    ratio = lambda a, c: F.when(c > 0, a.cast("double") / c)
    metrics = F.struct(
        F.struct(e["wer"].alias("wer"), e["words"].alias("ref_word_count")).alias("wer"), F.struct(e["cer"].alias("cer"), e["chars"].alias("ref_char_count")).alias("cer"),
        F.struct(ratio(e["corrupted"], e["borders"]).alias("rate"), e["borders"].alias("n_boundaries"), e["corrupted"].alias("n_corrupted")).alias("boundary_corruption"),
        F.when(e["excerpts"] > 0, F.struct(ratio(e["preserved"], e["excerpts"]).alias("recall"), e["excerpts"].alias("n_excerpts"), e["preserved"].alias("n_preserved"))).alias("policy_term_recall"),
        e["rtf"].alias("real_time_factor"),
    )
    return _per_source(b).select("file_id", "language", "user_id", F.when(e["ok"], "success").otherwise("error").alias("status"), F.concat(F.lit("heard "), "file_id").alias("full_text"), F.when(e["measured"], metrics).alias("metrics"), "source", "chunk_seconds")


def semantic_documents(b: DataFrame) -> DataFrame:
    e = {n: of(x) for n, x in SEMANTIC.items()}
    found = F.array(F.struct(F.lit("negation_flipped").alias("category"), e["affected"].alias("word_count_affected")), F.struct(F.lit("key_content_missing").alias("category"), F.lit(0).cast("long").alias("word_count_affected")))
    return _per_source(b).where(e["there"]).select("file_id", F.when(e["ok"], "success").otherwise("error").alias("status"), e["value"].alias("semantic_wer"), e["words"].alias("reference_word_count"), e["affected"].alias("affected_word_count"), F.slice(found, F.lit(1), (F.col("user_id") % 3).cast("int")).alias("discrepancies"), "source", "chunk_seconds")


def folder(spark: SparkSession, sf_dir: str, part: str) -> str:
    """Where a part of the fixture is; it is written the first time that it is asked for."""
    root = f"{shared_folder(spark)}/{made_from(spark, f'{sf_dir}/events.parquet')}"
    path = f"{root}/{part}"
    if path in _written:
        return path
    b = X.base(spark, sf_dir)
    if part == "gt":
        gt_documents(b).write.mode("overwrite").json(path)
    elif part == "results":
        model_documents(b).write.mode("overwrite").partitionBy("run_key").json(path)
    elif part == "asr":
        asr_documents(b).write.mode("overwrite").partitionBy("source", "chunk_seconds").json(path)
    elif part == "semantic":
        semantic_documents(b).write.mode("overwrite").partitionBy("source", "chunk_seconds").json(path)
    elif part == "log":
        lines = X.table(spark, sf_dir, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), "event_type", F.lit("] call_"), "user_id", F.lit(" "), "event_id").alias("value"))
        noise = lines.limit(0).union(spark.createDataFrame([("Traceback (most recent call last):",), ("",)], "value string"))
        lines.unionByName(noise).write.mode("overwrite").text(path)
    elif part == "jsonl":
        rows = b.where("event_id % 5 = 0").select("event_id", "category", "confidence")
        rows.where("event_id % 2 = 0").write.mode("overwrite").json(path)
        rows.where("event_id % 2 = 1").write.mode("append").json(path)
    elif part == "timing":
        rows = X.files(b).where("user_id % 4 <> 1").select("run_key", "file_id", F.when(F.col("user_id") % 5 == 0, None).otherwise((F.col("user_id") % 40 + 2).cast("double") / 4).alias("inference_time_sec"))
        rows.write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown part {part}")
    _written.add(path)
    return path
