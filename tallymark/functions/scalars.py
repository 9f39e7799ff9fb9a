"""Column functions over timestamps, JSON replies, transcripts, scores and tokens (SC*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SECONDS = 28.0
#: Unicode blocks of the scripts of the languages
SCRIPTS = {"hindi": "ऀ-ॿ", "tamil": "஀-௿", "telugu": "ఀ-౿", "kannada": "ಀ-೿", "malayalam": "ഀ-ൿ"}


def clock_seconds(t: Column) -> Column:
    """'MM:SS' or 'H:MM:SS' in seconds, with decimals; anything else is null."""
    parts = F.split(F.trim(t), ":")
    num = lambda i: parts.getItem(i).try_cast("double")
    return F.when(F.size(parts) == 2, num(0) * 60 + num(1)).when(F.size(parts) == 3, num(0) * 3600 + num(1) * 60 + num(2))


def lenient_seconds(t: Column) -> Column:
    """As clock_seconds, and also '5s', '84.0s' and bare '11'."""
    bare = F.regexp_extract(F.trim(t), r"^([0-9]+(?:\.[0-9]+)?)\s*s?$", 1)
    return F.coalesce(clock_seconds(t), F.when(bare != "", bare.cast("double")))


def strict_seconds(t: Column) -> Column:
    """Whole numbers only, one or two digits a part."""
    ok = F.regexp_like(t, F.lit(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"))
    return F.when(ok, clock_seconds(t))


def clock(seconds: Column, rounding: bool = False) -> Column:
    """Seconds as MM:SS, truncated or rounded; minutes may exceed 59."""
    whole = (F.round(seconds) if rounding else F.floor(seconds)).cast("long")
    return F.when(whole.isNotNull(), F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60))


def first_clock(t: Column) -> Column:
    """The first timestamp in a text, else the text."""
    return F.coalesce(F.nullif(F.regexp_extract(t, r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?", 0), F.lit("")), t)


def shifted_clock(t: Column, offset: Column) -> Column:
    """A chunk's timestamp in the whole recording; one that cannot be read stays."""
    return F.coalesce(clock(lenient_seconds(t) + offset), t)


def at_chunk_border(seconds: Column, chunk: float = CHUNK_SECONDS, slack: float = 0.5) -> Column:
    rest = F.pmod(seconds, F.lit(chunk))
    return (rest <= slack) | ((F.lit(chunk) - rest) <= slack)


def without_fence(reply: Column) -> Column:
    """A reply without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def repaired(reply: Column) -> Column:
    return F.regexp_replace(reply, r'"box_2d"\s*:\s*\[', '"t": "')


def wire_flags(reply: Column, schema: str) -> Column:
    """The flag list of {"d": [...]} or of a bare array; anything else has no flags."""
    clean = without_fence(reply)
    boxed = F.from_json(clean, f"struct<d: {schema}>").getField("d")
    bare = F.when(clean.startswith("["), F.from_json(clean, schema))
    return F.coalesce(bare, boxed, F.array().cast(schema))


def script_share(text: Column, language: Column) -> Column:
    """Share of letters in the language's script; null without letters or for an unknown language."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    inside = reduce(lambda acc, kv: acc.when(language == kv[0], F.regexp_count(text, F.lit(f"[\\p{{L}}&&[{kv[1]}]]"))), SCRIPTS.items(), F.when(F.lit(False), F.lit(0)))
    return F.when(letters > 0, inside / letters)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def unit(vector: Column) -> Column:
    """An array as doubles of length 1; one without length stays as it is."""
    values = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(values, lambda x: x / length)).otherwise(values)


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays that ``unit`` made."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _ratio_bound(shared: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(shared * 2.0 / total)


def ratio_bound_by_length(a: Column, b: Column) -> Column:
    """What text_ratio cannot exceed, by the lengths alone; null counts as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return _ratio_bound(F.least(F.length(a), F.length(b)), a, b)


def ratio_bound_by_letters(a: Column, b: Column) -> Column:
    """What text_ratio cannot exceed, by how often each character occurs in both; null counts as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return _ratio_bound(shared, a, b)


def time_decay(delta: Column, known: Column, tau: float = 20.0, unknown: float = 0.7) -> Column:
    return F.when(known, F.exp(-delta / tau)).otherwise(unknown)


def tenth_bin(v: Column, cap: float = 1.5) -> Column:
    """'0.2-0.3' and so on, cut by truncation of v / 0.1 as doubles; '1.5+' at the end."""
    k = (v / F.lit(0.1)).cast("int")
    return F.when(v.isNull(), None).when(v >= cap, F.lit(f"{cap}+")).otherwise(F.format_string("%.1f-%.1f", k / F.lit(10.0), (k + 1) / F.lit(10.0)))


def short_id(file_id: Column) -> Column:
    parts = F.split(file_id, "_")
    return F.when(F.size(parts) >= 3, parts.getItem(2)).otherwise(file_id)


def normal_text(text: Column) -> Column:
    """Without [inaudible] marks and punctuation, white space collapsed; digits stay. NFC is expected of the input."""
    unmarked = F.regexp_replace(text, r"(?i)\[?\s*inaudible\s*\]?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(unmarked, r"\p{P}", " "), r"(?U)\s+", " "))


def geometric_confidence(logprob_decision: Column, logprob_category: Column) -> Column:
    return F.sqrt(F.exp(logprob_decision) * F.exp(logprob_category))


def entropy(logprobs: Column, renormalise: bool = True) -> Column:
    """-sum p log p over an array of log probabilities, renormalised over those given if asked."""
    p = F.transform(logprobs, lambda x: F.exp(x))
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v) if renormalise else F.lit(1.0)
    return -F.aggregate(F.transform(p, lambda x: x / total), F.lit(0.0), lambda s, v: s + F.when(v > 0, v * F.log(v)).otherwise(0.0))


def yes_probability(token: Column, logprob: Column, top: Column) -> Column:
    """P(yes) of a yes/no token: itself, or yes among the alternatives, or the complement."""
    word = F.lower(F.trim(token))
    yes = F.get(F.filter(top, lambda x: F.lower(F.trim(x["token"])) == "yes"), F.lit(0))
    return F.when(word == "yes", F.exp(logprob)).when(yes.isNotNull(), F.exp(yes["logprob"])).when(word == "no", 1 - F.exp(logprob))


def incomplete(duration: Column, end: Column) -> Column:
    """Whether a transcript stops too early: a gap above 15 s and above a tenth of the duration."""
    return (duration - end) > F.greatest(F.lit(15.0), 0.1 * duration)


def round_half_even(x: Column, scale: int = 100) -> Column:
    """x to the nearest 1/scale, decided on its exact binary value, ties to even; null stays null.

    The error of the product x * scale is computed exactly by splitting x, so that a value
    that lies just below or above a half in binary is not taken for one.
    """
    s = F.lit(float(scale))
    p = x * s
    high = (x * F.lit(134217729.0)) - (x * F.lit(134217729.0) - x)
    error = (high * s - p) + (x - high) * s
    whole = F.floor(p).cast("double")
    over = p - whole - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
    return F.when(up, whole + 1).otherwise(whole) / s


def display_name(run: Column, prompt: Column) -> Column:
    """Name of a run as <model>_<thinking|nothinking>_<prompt>; two hosted families have names of their own (fixed values)."""
    thinking = lambda yes: F.when(yes, "thinking").otherwise("nothinking")
    old = F.concat(F.lit("gemini-3.1-FL_"), thinking(~run.endswith("_nothink")), F.lit("_"), prompt)
    new = F.concat(F.lit("gemini-3.5-flash-lite_"), prompt)
    other = F.concat_ws("_", F.substring_index(run, "_", 1), thinking(run.endswith("thinking") & ~run.endswith("nothinking")), prompt)
    return F.when(run.startswith("gemini-3.1-flash-lite"), old).when(run.startswith("gemini-3.5-flash-lite"), new).otherwise(other)


#: fixed values: parts of a run's key and the input that they stand for, the first that fits counts
INPUTS = [
    ("31bthinkEN", False, "text (English, Gemma 31B-thinking translation of ITC)"),
    ("31bEN", False, "text (English, Gemma 31B translation of ITC)"),
    ("flash-lite_audio", True, "audio"),
    ("audiotrans", False, "text (English, Gemini-translated from audio)"),
    ("itc", False, "text (Indic-Transcribe-Core)"),
    ("conformer", False, "text (Indic-Conformer)"),
]


def run_input(run: Column) -> Column:
    """What a run was given, from its key; audio if nothing else is said."""
    out = F.when(F.lit(False), "")
    for part, at_end, name in INPUTS:
        out = out.when(run.endswith(part) if at_end else F.contains(run, F.lit(part)), name)
    return out.otherwise("audio")
