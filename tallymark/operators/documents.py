"""Operators over transcripts, replies and result documents (P13, P14, E*, SC11, SC12, SC31, SC35, SC36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clock_seconds, lenient_seconds

TAXONOMY_FIELDS = ["speech_act", "violation", "quote_type"]


# --- replies and transcripts -----------------------------------------------------------------


def sound_segments(segments: Column) -> Column:
    """Segments whose t and text are both there; only malformed ones go."""
    return F.filter(segments, lambda s: s["t"].isNotNull() & s["text"].isNotNull())


SALVAGE = r'\{\s*"t"\s*:\s*"([^"]*)"\s*,\s*"en"\s*:\s*"((?:[^"\\]|\\.)*)"\s*\}'


def salvaged(reply: Column) -> Column:
    """The complete {t, en} objects of a reply whose JSON breaks off, with their texts unescaped."""
    found = F.regexp_extract_all(reply, F.lit(SALVAGE), F.lit(0))
    return F.transform(found, lambda o: F.from_json(o, "t string, en string"))


def resumed(replies: Column) -> Column:
    """Segments of a file's replies in order: of each, those later than the last one kept before it."""
    sec = lambda s: F.coalesce(lenient_seconds(s["t"]), F.lit(0.0))
    fits = lambda kept, s: (F.size(kept) == 0) | (sec(s) > sec(F.element_at(kept, -1)))
    start = F.filter(F.get(replies, F.lit(0)), lambda s: F.lit(False))
    return F.aggregate(replies, start, lambda kept, reply: F.concat(kept, F.filter(reply, lambda s: fits(kept, s))))


def alignment(source: Column, reply: Column) -> dict[str, Column]:
    """Whether a reply has the source's segments one by one, and the halves (first, length) to ask again if not."""
    both = F.arrays_zip(source.alias("a"), reply.alias("b"))
    bad = F.filter(F.transform(both, lambda z, i: F.when(z["a"]["t"].eqNullSafe(z["b"]["t"]), -1).otherwise(i)), lambda i: i >= 0)
    same = (F.size(source) == F.size(reply)) & (F.size(bad) == 0)
    half = F.greatest(F.lit(1), F.floor(F.size(source) / 2).cast("int"))
    starts = F.sequence(F.lit(0), F.size(source) - 1, half)
    parts = F.transform(starts, lambda i: F.struct(i.alias("first"), F.least(half, F.size(source) - i).alias("length")))
    return {"aligned": same, "n_bad": F.size(bad), "first_bad": F.get(bad, F.lit(0)), "ask_again": F.when(~same & (F.size(source) > 0), parts)}


def polymorphic_segments(raw: Column) -> Column:
    """Segments (t_sec, text) of a transcript document of any known shape.

    The list is under segments, utterances or transcript, at the top or one level down; it
    may be one text, and its items may be texts. Times are under t, timestamp or start, as
    clock or number; texts under text, native or transcript, after a speaker if one is named.
    """
    filled = lambda c: F.when(~c.isin("", "[]", "{}"), c)
    inner = F.get_json_object(raw, "$.transcript")
    nested = F.coalesce(inner.startswith("{"), F.lit(False))
    doc = F.when(nested, inner).otherwise(raw)
    own = F.get_json_object(doc, "$.transcript")
    listed = F.coalesce(filled(F.get_json_object(doc, "$.segments")), filled(F.get_json_object(doc, "$.utterances")), filled(F.when(~nested, own)))
    items = F.from_json(listed, "array<string>")

    def item(s: Column) -> Column:
        at = lambda *names: F.coalesce(*[filled(F.get_json_object(s, f"$.{n}")) for n in names])
        is_text = ~s.startswith("{")
        speaker = at("speaker", "spk")
        text = F.coalesce(at("text", "native", "transcript"), F.lit(""))
        return F.struct(
            F.when(~is_text, lenient_seconds(at("t", "timestamp", "start"))).alias("t_sec"),
            F.when(is_text, s).when(speaker.isNotNull(), F.concat(speaker, F.lit(": "), text)).otherwise(text).alias("text"),
        )

    whole = F.array(F.struct(F.lit(None).cast("double").alias("t_sec"), listed.alias("text")))
    none = F.array().cast("array<struct<t_sec: double, text: string>>")
    return F.when(listed.isNull(), none).when(listed.startswith("["), F.transform(items, item)).otherwise(whole)


def context_lines(segments: Column, full_text: Column, center: Column, excerpt: Column, limit: int = 6000, seconds: float = 90.0, sep: str = r"\s+") -> Column:
    """The lines to judge a flag by: all of a short transcript, else those near the flag or with a word of its excerpt; all if there is none.

    ``sep`` (a regular expression) parts the words of the excerpt.
    """
    words = F.filter(F.split(excerpt, sep), lambda w: F.length(w) >= 3)
    near = lambda s: F.coalesce(F.abs(clock_seconds(s["t"]) - center) <= seconds, F.lit(False))
    # words are bound by a lambda, so that they are computed once and not once a segment
    picked = F.get(F.transform(F.array(words), lambda found: F.filter(segments, lambda s: near(s) | F.exists(found, lambda w: F.contains(s["text"], w)))), F.lit(0))
    chosen = F.when((F.length(full_text) <= limit) | (F.size(picked) == 0), segments).otherwise(picked)
    lines = F.array_join(F.transform(chosen, lambda s: F.concat(F.lit("["), s["t"], F.lit("] "), s["text"])), "\n")
    return F.when(F.size(segments) == 0, full_text).otherwise(lines)


#: fixed values: how a section is marked, and how a heading begins that ends it
SECTION_MARK, HEADING = r"\*\*\[[^\]]+\]\*\*", r"\n\s*(?:#{1,3} |\*\*[A-Z][A-Z ]+\*\*)"
SECTION = rf"(?s){SECTION_MARK}.*?(?={SECTION_MARK}|{HEADING}|\z)"


def sections(text: Column) -> Column:
    """Sections (name, body) of a text: each from a **[Name]** mark to the next mark or top-level heading, blank lines thinned out."""
    blank_lines = lambda s: F.regexp_replace(F.trim(s), r"\n{3,}", "\n\n")
    name = lambda s: F.substring_index(F.substring_index(s, "]**", 1), "**[", -1)
    return F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)), lambda s: F.struct(name(s).alias("name"), blank_lines(F.regexp_replace(s, r"\s+$", "")).alias("body")))


def question(framing: str, section: Column, short: bool) -> Column:
    """A question about a section: the framing and the whole section, or the first line after its mark."""
    lines = F.filter(F.transform(F.split(section, "\n"), F.trim), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(1)), F.get(lines, F.lit(0)))
    return F.concat(F.lit(framing), first if short else section)


# --- flags and their audit -------------------------------------------------------------------


def audit_batches(flags: DataFrame, verdicts: DataFrame, taxonomy: str, prompt_hash: str) -> DataFrame:
    """Per run and file with work to do: all its flags, once, and ``todo``, the indexes of its items among them.

    Items are the unmatched flags without a verdict of this taxonomy and prompt. The rows are as
    large as the flags that they hold, however many items a file has. ``flags``: run_key,
    file_id, flag_idx, category, matched; ``verdicts``: run_key, file_id, flag_idx,
    taxonomy_version, prompt_hash.
    """
    keys = ["run_key", "file_id", "flag_idx"]
    valid = verdicts.where((F.col("taxonomy_version") == taxonomy) & (F.col("prompt_hash") == prompt_hash)).select(*keys).distinct().withColumn("_done", F.lit(True))
    marked = flags.join(valid, keys, "left").withColumn("_todo", (F.col("matched") == F.lit(False)) & F.col("_done").isNull())
    of_file = F.array_sort(F.collect_list(F.struct("flag_idx", "category", "matched", F.coalesce("_todo", F.lit(False)).alias("todo"))))
    rows = marked.groupBy("run_key", "file_id").agg(of_file.alias("all"))
    todo = F.transform(F.filter("all", lambda x: x["todo"]), lambda x: x["flag_idx"])
    return rows.select("run_key", "file_id", F.transform("all", lambda x: x.dropFields("todo")).alias("flags"), todo.alias("todo")).where(F.size("todo") > 0)


def work_items(batches: DataFrame) -> DataFrame:
    """A row for each item of ``audit_batches`` with the other flags of its file, for a sink that needs them so.

    These rows are as many as the square of a file's flags; what comes before the sink should
    carry the batches.
    """
    items = batches.select("run_key", "file_id", "flags", F.explode("todo").alias("flag_idx"))
    own = F.get(F.filter("flags", lambda x: x["flag_idx"] == F.col("flag_idx")), F.lit(0))
    others = F.filter("flags", lambda x: x["flag_idx"] != F.col("flag_idx"))
    return items.select(F.concat_ws("::", "run_key", "file_id", "flag_idx").alias("item_id"), "run_key", "file_id", "flag_idx", own["category"].alias("category"), others.alias("other_flags"))


def missing_counts(flags: DataFrame, prompt: Column, keys: list[str], has_field) -> DataFrame:
    """Flags without a confidence, and without each field that their prompt version declares."""
    gone = lambda f: F.count_if(has_field(prompt, f) & F.col(f).isNull()) if f in flags.columns else F.sum(F.when(has_field(prompt, f), 1).otherwise(0))
    return flags.groupBy(*keys).agg(F.count_if(F.col("confidence").isNull()).alias("c"), *[gone(f).alias(f) for f in TAXONOMY_FIELDS])


def union_of_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """A file's result from its chunks (keys, offset, failed, flags, missing): failed only if every chunk failed."""
    ordered = F.array_sort(F.collect_list(F.when(~F.col("failed"), F.struct("offset", "flags"))))
    return chunks.groupBy(*keys).agg(
        F.flatten(F.transform(ordered, lambda c: c["flags"])).alias("flags"), F.count("*").alias("chunks_total"), F.count_if("failed").alias("chunks_failed"),
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col("missing"))), F.lit(0)).alias("missing"), F.when(F.bool_and("failed"), "error").otherwise("success").alias("status"),
    )


def frame_levels(samples: DataFrame, key: str, frame: int) -> DataFrame:
    """Level in dB of every whole frame of samples (key, i, amplitude)."""
    rms = F.sqrt(F.avg(F.col("amplitude") * F.col("amplitude")) + 1e-12)
    frames = samples.groupBy(key, F.floor(F.col("i") / frame).alias("frame")).agg(F.count("*").alias("n"), (20 * F.log10(rms + 1e-12)).alias("db"))
    return frames.where(F.col("n") == frame).drop("n")


def snr_table(files: DataFrame, levels: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Noise floor, speech level and their distance per file; blank for files without enough frames."""
    stats = levels.groupBy(key).agg(F.count("*").alias("n"), F.percentile("db", 0.1).alias("noise_floor_db"), F.percentile("db", 0.9).alias("speech_level_db")).where(F.col("n") >= least)
    return files.select(key).distinct().join(stats, key, "left").select(key, "noise_floor_db", "speech_level_db", (F.col("speech_level_db") - F.col("noise_floor_db")).alias("snr_db"))


def ledger_lookup(stage_rows: DataFrame, ledger: DataFrame, earlier: str) -> DataFrame:
    """A later stage's rows with the audio duration that an earlier stage of the ledger recorded first, and their rate."""
    first = W.partitionBy("file_id").orderBy("seq")
    found = ledger.where(F.col("stage") == earlier).withColumn("_i", F.row_number().over(first)).where("_i = 1").select("file_id", "audio_duration_sec")
    return stage_rows.join(found, "file_id").withColumn("rtf", F.col("seconds") / F.col("audio_duration_sec"))


#: fixed values: ends of a reply that come again with the same input
FINAL_REASONS = ["RECITATION", "SAFETY", "PROHIBITED_CONTENT", "BLOCKLIST", "SPII"]


def next_step(attempt: Column, ok: Column, code: Column, reason: Column, most: int, base: float) -> dict[str, Column]:
    """What follows an attempt of a model call: done, failed or again, and the seconds to wait before."""
    final = F.coalesce(code == 400, F.lit(False)) | F.coalesce(reason.isin(*FINAL_REASONS), F.lit(False)) | (attempt >= most)
    step = F.when(ok, "done").when(final, "failed").otherwise("again")
    return {"step": step, "wait_s": F.when(step == "again", F.pow(F.lit(base), attempt))}
