"""Typed readers of result documents: nested JSON, JSON lines, CSV and logs (IO5, IO6, IO8, IO13, IO14, IO17, E3, E4, M*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import prompt_of_source

WIRE_FLAG = "struct<f: string, t: string, tr: string, vb: string, j: string, c: double, sec: int, id: bigint>"
GT_SCHEMA = (
    "file_id string, language string, user_id bigint, status string, error string, "
    "transcript struct<status: string, segments: array<struct<t: string, text: string>>, full_text: string, incomplete_transcript: boolean>, "
    f"classification struct<status: string, d: array<{WIRE_FLAG}>>"
)
MODEL_FLAG = "struct<id: bigint, category: string, t: string, confidence: double, logprob_confidence: double, entropy: struct<mean: double>, speech_act: string, violation: string>"
MODEL_SCHEMA = f"file_id string, language string, user_id bigint, status string, error string, inference_time_sec double, flags array<{MODEL_FLAG}>, run_key string"
ASR_SCHEMA = (
    "file_id string, language string, user_id bigint, status string, full_text string, metrics struct<"
    "wer: struct<wer: double, ref_word_count: bigint>, cer: struct<cer: double, ref_char_count: bigint>, "
    "boundary_corruption: struct<rate: double, n_boundaries: bigint, n_corrupted: bigint>, "
    "policy_term_recall: struct<recall: double, n_excerpts: bigint, n_preserved: bigint>, real_time_factor: double>, source string, chunk_seconds bigint"
)
SEMANTIC_SCHEMA = (
    "file_id string, status string, semantic_wer double, reference_word_count bigint, affected_word_count bigint, "
    "discrepancies array<struct<category: string, word_count_affected: bigint>>, source string, chunk_seconds bigint"
)

#: Results of model calls come as tables; what is required of each stage's rows, besides the key file_id.
STAGES = {
    "transcription": "file_id string, t_sec int, text string, status string",
    "classification": "file_id string, category string, t_sec int, confidence double, status string",
    "topic_tags": "file_id string, topic string, status string",
    "chunk_flags": "file_id string, chunk_offset_sec bigint, category string, t_sec int, status string",
    "hosted_flags": "file_id string, run_key string, category string, confidence double, status string",
    "asr_windows": "file_id string, window_start_sec bigint, text string, status string",
    "translation": "file_id string, t_sec int, en string, status string",
    "embeddings": "file_id string, embedding array<double>, status string",
    "match_verdicts": "run_key string, file_id string, gi bigint, mi bigint, confirmed boolean, status string",
    "fp_verdicts": "run_key string, file_id string, flag_idx bigint, fp_type string, status string",
    "judgements": "file_id string, significant boolean, status string",
    "zero_shot": "file_id string, question string, probability double, status string",
    "local_timing": "file_id string, seconds double, audio_sec double, status string",
}


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with the given fields; folders like key=value are columns, on which scans are pruned."""
    return spark.read.schema(schema).json(path)


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """A stage's successful rows, with its declared columns; unknown stages are an error."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    return read_documents(spark, path, STAGES[stage]).where("status = 'success' and file_id is not null").drop("status")


def run_stage(rows: DataFrame, stage: str, call) -> DataFrame:
    """A stage computed by an injected function from batches of rows (iterator of pandas frames) to its declared columns."""
    return rows.mapInPandas(call, STAGES[stage])


def successful_gt(docs: DataFrame) -> DataFrame:
    """Reference documents of which document, transcript and classification are all successful."""
    return docs.where("status = 'success' and transcript.status = 'success' and classification.status = 'success'")


def gt_flags_of(docs: DataFrame, cleaned: Column) -> DataFrame:
    """One row a reference flag with its place and full names; ``cleaned`` is the timestamp made from the flag's x.t."""
    flags = successful_gt(docs).select("file_id", "language", F.posexplode("classification.d").alias("gt_index", "x"))
    return flags.select("file_id", "language", "gt_index", F.col("x.id").alias("event_id"), F.col("x.f").alias("ground_truth_category"), cleaned.alias("ground_truth_timestamp"), F.col("x.c").alias("ground_truth_confidence"))


def model_flags_of(docs: DataFrame) -> DataFrame:
    """One row a flag of the successful result documents, in the order of the document, with its negated mean entropy."""
    flags = docs.where("status = 'success'").select("run_key", "file_id", "language", F.posexplode("flags").alias("flag_idx", "x"))
    return flags.select("run_key", "file_id", "language", "flag_idx", "x.*", (-F.col("x.entropy.mean")).alias("neg_entropy")).drop("entropy")


def asr_rows(docs: DataFrame) -> DataFrame:
    """One flat row a transcribed file with every metric and its weight; missing counts are 0."""
    m = "metrics."
    zero = lambda c: F.coalesce(F.col(m + c), F.lit(0))
    return docs.where("status = 'success' and metrics is not null").select(
        "source", "chunk_seconds", "file_id", "language", F.col(m + "wer.wer"), zero("wer.ref_word_count").alias("wer_ref_word_count"),
        F.col(m + "cer.cer"), zero("cer.ref_char_count").alias("cer_ref_char_count"), F.col(m + "boundary_corruption.rate").alias("boundary_corruption_rate"),
        zero("boundary_corruption.n_boundaries").alias("n_boundaries"), zero("boundary_corruption.n_corrupted").alias("n_corrupted"),
        F.col(m + "policy_term_recall.recall").alias("policy_term_recall"), zero("policy_term_recall.n_excerpts").alias("n_excerpts"), zero("policy_term_recall.n_preserved").alias("n_preserved"),
        F.col(m + "real_time_factor").alias("real_time_factor"),
    )


def semantic_rows(docs: DataFrame) -> DataFrame:
    return docs.where("status = 'success' and semantic_wer is not null").select("source", "chunk_seconds", "file_id", "semantic_wer", "reference_word_count", "affected_word_count", "discrepancies")


LOG_LINE = r"^(\S+ \S+) \[(\w+)\] (\S+) (\d+)$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines '<date> <time> [level] <file> <number>' of text logs; other lines are left out."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    return lines.where(F.regexp_like("value", F.lit(LOG_LINE))).select(part(1).cast("timestamp_ntz").alias("at"), part(2).alias("level"), part(3).alias("file_id"), part(4).cast("long").alias("event_id"))


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt files of a folder, whole: name, version and text."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return prompts(files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("source")))


def prompts(files: DataFrame) -> DataFrame:
    """name, version and text of prompt files (name, source); of a Python file, what its get_prompt() returns."""
    of_python = prompt_of_source(F.when(F.col("name").endswith(".py"), F.col("source")))
    version = F.nullif(F.regexp_extract("name", r"_(v[0-9]+)\.", 1), F.lit(""))
    return files.select("name", version.alias("version"), F.coalesce(of_python, "source").alias("text"))


def chunk_windows(files: DataFrame, seconds: float) -> DataFrame:
    """The windows that a recording (file_id, duration_s) is cut into: their numbers, offsets and lengths, the last one shorter."""
    n = F.ceil(F.col("duration_s") / seconds).cast("int")
    cut = files.where("duration_s > 0").select("file_id", "duration_s", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return cut.select("file_id", "chunk", (F.col("chunk") * seconds).alias("offset_s"), F.least(F.lit(seconds), F.col("duration_s") - F.col("chunk") * seconds).alias("length_s"))


AUDIO_PATH = r"/([a-z]+)_([A-Za-z\-]+)/(TP|FP|FN)(?:/(Single|Multi))?/([^/]+\.([A-Za-z0-9]+))$"
POOLED_PATH = r"/TN/([^/]+\.([A-Za-z0-9]+))$"


def pooled_layout(paths: DataFrame, extensions: list[str]) -> DataFrame:
    """Files of the layout with cells language_category/TP|FP|FN and one pool TN, by their paths alone."""
    cell = lambda i: F.nullif(F.regexp_extract("path", AUDIO_PATH, i), F.lit(""))
    pool = lambda i: F.nullif(F.regexp_extract("path", POOLED_PATH, i), F.lit(""))
    rows = paths.select(
        F.coalesce(cell(5), pool(1)).alias("file_id"), "path", cell(1).alias("language"), cell(2).alias("category"), F.coalesce(cell(3), F.when(pool(1).isNotNull(), "TN")).alias("outcome"),
        F.lower(F.when(cell(3) == "TP", cell(4))).alias("multiplicity"), F.lower(F.coalesce(cell(6), pool(2))).alias("ext"),
    )
    multiplied = (F.col("outcome") != "TP") | F.col("multiplicity").isNotNull()
    return rows.where(F.col("ext").isin(*extensions) & multiplied).drop("ext")


def full_runs(folders: DataFrame) -> DataFrame:
    """Result folders of whole runs and their prompt version; folders of other kinds are left out."""
    version = F.regexp_extract("folder", r"^analysis_results_promptv([0-9]+)$", 1)
    prompt = F.when(F.col("folder") == "analysis_results", "v1").when(version != "", F.concat(F.lit("v"), version))
    return folders.withColumn("prompt", prompt).where("prompt is not null")
