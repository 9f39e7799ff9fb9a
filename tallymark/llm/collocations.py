"""Phrase collocation mining by Apriori level-wise passes (operator 11).

Texts are lower-cased (A-Z), split at .,;:!? and \\x0A-\\x0D into pieces, and those at spaces
and tabs into words. Per language, phrases of 2 to 5 words that occur at least 100 times
within pieces are candidates.

1. Pass k counts phrases of k words. A phrase is emitted only where both its overlapping
   phrases of k - 1 words are frequent. These are broadcast as a bitmap of hashes (16 bits or
   more for each phrase, up to ``MOST_BITS``, so its size is bounded whatever the input). A
   false positive is counted in vain, since no phrase occurs more often than a part of it;
   so the counts are exact. A batch counts its own phrases by numbers, and only distinct ones
   leave the worker, as text, to be added up by Spark with map-side combining.
2. Cuts: a candidate is cut after each word, both sides are looked up in the level tables and
   the lowest score floor(1000 a n / (l r)) counts, in decimals of 38 digits.
3. A candidate inside a longer candidate with as many occurrences goes, by a join on all
   phrases inside the longer ones.
4. The best of each language are ranked in two steps, first in ``SHARES`` shares by a hash of
   the phrase, so that one language is not one task.

Defined cases: a null text counts as empty and has no phrases; a null language is ``und``, and
is the same as that label; equal scores and counts are ranked by phrase in UTF-8 byte order,
cuts of equal score by the shorter first part; repeated rows count each time, whatever their
doc_id; a phrase that occurs exactly ``LEAST`` times is a candidate; occurrences may overlap
(``a a a`` holds ``a a`` twice); texts of any length are read whole; without candidates, as in
an empty table, the result is empty; columns beyond text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, read, staged, tidied, utf8

LONGEST = 5
LEAST = 100
BEST = 2000
SCALE = 1000
#: A candidate goes if a longer one around it has this share of its occurrences, in percent.
INSIDE_PERCENT = 100
SHARES = 64
#: Bits of the bitmap for each frequent phrase, and in all (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: A bitmap is put together from pieces of so many bits.
PIECE_BITS = 1 << 15
#: Word places of one language that are counted at once.
PLACES = 4_000_000

_BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words numbered as they come, from 1; the break between pieces is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def phrase_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on, from the hashes of the words."""
    n = max(0, len(words) - k + 1)
    total = np.full(n, np.uint64(k))
    for i in range(k):
        total = _mix(total * _STEP + words[i : i + n])
    return total


def seeded(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 7)


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places in a bitmap of that many bits (a power of two) for each hash; two rows."""
    low = np.uint64(bits - 1)
    return np.stack([hashes & low, (hashes >> np.uint64(28)) & low]).astype(np.int64)


def word_numbers(texts: list[bytes], numbers: _Numbers) -> np.ndarray:
    """The texts' words one after the other as numbers, with 0 between pieces and texts."""
    found = [np.zeros(1, np.int32)]
    for text in texts:
        words = text.translate(_TABLE).replace(_BREAK, b" \xff ").split()
        words.append(_BREAK)
        found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    return np.concatenate(found)


def level_counts(ids: np.ndarray, k: int, sub_ok: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase of k words, and how often it occurs; ``sub_ok`` says where a frequent phrase of k - 1 words begins."""
    n = max(0, len(ids) - k + 1)
    fits = ids[:n] > 0
    for i in range(1, k):
        fits &= ids[i : i + n] > 0
    if sub_ok is not None:
        fits &= sub_ok[:n] & sub_ok[1 : n + 1]
    at = np.flatnonzero(fits)
    if k == 1:
        counts = np.bincount(ids[at])
        place = np.zeros(len(counts), np.int64)
        place[ids[at]] = at
        return place[counts > 0], counts[counts > 0]
    # a phrase is numbered by its first part's number and its last word
    number = ids[at].astype(np.int64)
    size = int(ids.max()) + 1
    for i in range(1, k):
        number = number * size + ids[at + i]
        if i < k - 1:
            _, number = np.unique(number, return_inverse=True)
    _, first, counts = np.unique(number, return_index=True, return_counts=True)
    return at[first], counts


def _count(k: int, frequent: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts (lang, phrase, n) of a batch's phrases of k words; in the first pass also all words of a language (phrase is null)."""

    def settle(lang: str, ids: np.ndarray, by_number: pa.Array, hashes: np.ndarray) -> pa.RecordBatch:
        sub_ok = None
        if frequent is not None:
            bitmap = np.frombuffer(frequent.value, np.uint8)
            own = phrase_hashes(hashes[ids], k - 1) ^ np.uint64(seeded(lang))
            sub_ok = np.ones(len(own), bool)
            for p in bit_places(own, len(bitmap) * 8):
                sub_ok &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        at, counts = level_counts(ids, k, sub_ok)
        parts = [by_number.take(pa.array(ids[at + i])) for i in range(k)]
        phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0]
        if k == 1:
            phrases = pa.concat_arrays([phrases, pa.nulls(1, pa.binary())])
            counts = np.append(counts, np.count_nonzero(ids))
        langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), pa.array([lang])).cast(pa.string())
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            rows: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                rows.setdefault(lang, []).append(i)
            numbers = _Numbers({_BREAK: 0})
            for lang, of in rows.items():
                ids = word_numbers(batch.column("text").take(pa.array(of)).to_pylist(), numbers)
                by_number = pa.array(numbers, pa.binary())
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in numbers), np.uint64, len(numbers)) if k > 1 else np.zeros(0, np.uint64)
                start = 0
                while start < len(ids):  # cut between pieces, so that no phrase is lost
                    end = min(len(ids), start + PLACES)
                    if end < len(ids):
                        breaks = np.flatnonzero(ids[start:end] == 0)
                        if len(breaks) > 1:
                            end = start + int(breaks[-1])
                        else:
                            later = np.flatnonzero(ids[end:] == 0)
                            end = end + int(later[0]) if len(later) else len(ids)
                    yield settle(lang, ids[start:end], by_number, hashes)
                    start = end

    return run


def _pieces(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bits (piece, bit) that the phrases (lang, phrase) set in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                words = np.array([xxhash.xxh64_intdigest(w, 42) for w in phrase.split(b" ")], np.uint64)
                found.append(int(phrase_hashes(words, len(words))[0]) ^ seeded(lang))
            places = np.unique(bit_places(np.array(found, np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((places // PIECE_BITS).astype(np.int32)), pa.array((places % PIECE_BITS).astype(np.int32))], names=["piece", "bit"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's bits (piece, bits as a list) as bytes."""
    for batch in batches:
        bits = []
        for on in batch.column("bits"):
            piece = np.zeros(PIECE_BITS, np.uint8)
            piece[on.values.to_numpy()] = 1
            bits.append(np.packbits(piece, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(bits, pa.binary())], names=["piece", "bits"])


def frequent_bitmap(phrases: DataFrame, n: int) -> bytes:
    """A bitmap of bounded size in which the hashes of all n phrases (lang, phrase) are set."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))
    places = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(_pieces(bits), "piece int, bit int").distinct()
    packed = places.groupBy("piece").agg(F.collect_list("bit").alias("bits")).mapInArrow(_packed, "piece int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in packed.toLocalIterator():  # as many bytes as the bitmap has
        whole[row["piece"] * PIECE_BITS // 8 :][: PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return whole.tobytes()


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Per number of words the frequent phrases (lang, phrase, f), and (lang, n), the words of a language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), utf8(F.col("text")).alias("text"))
    found: list[DataFrame] = []
    words = None
    frequent: Broadcast | None = None
    for k in range(1, longest + 1):
        counted = rows.mapInArrow(tidied(_count(k, frequent)), "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        table = staged(counted.where(F.col("phrase").isNull() | (F.col("f") >= least)).select("lang", F.col("phrase").cast("string").alias("phrase"), "f"), f"phrases-{k}")
        if frequent is not None:
            frequent.unpersist()
        if k == 1:
            words = table.where("phrase is null").select("lang", F.col("f").alias("n"))
        level = table.where("phrase is not null")
        n = level.count()
        found.append(level)
        if not n:
            break
        if k < longest:
            frequent = spark.sparkContext.broadcast(frequent_bitmap(level, n))
    return found, words


def _words_of(phrase: str) -> Column:
    return F.split(phrase, " ")


def scored(found: list[DataFrame], words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate by its lowest-scoring cut."""
    every = found[0]
    for level in found[1:]:
        every = every.unionByName(level)
    longer = found[1]
    for level in found[2:]:
        longer = longer.unionByName(level)
    part = lambda a, b: F.concat_ws(" ", F.slice("w", a, b))
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), _words_of("phrase").alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w")).alias("rest"))
    of = lambda c, f: every.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(words, "lang")
    # decimals: the products may pass 64 bits
    score = F.expr(f"(cast(a as decimal(16,0)) * cast(n as decimal(17,0)) * cast({SCALE} as decimal(5,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def inside(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, most): phrases of two words or more inside longer frequent ones, and how often the most frequent of these occurs."""
    longer = found[2]
    for level in found[3:]:
        longer = longer.unionByName(level)
    rows = longer.select("lang", "f", _words_of("phrase").alias("w")).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    return rows.groupBy("lang", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("f").alias("most"))


def ranked(candidates: DataFrame, best: int = BEST) -> DataFrame:
    """The first of each language by score, count and phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = candidates.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    some = share.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best).drop("share")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language of ``docs`` (text, lang)."""
    found, words = levels(docs, longest, least)
    if len(found) < 2:
        spark = docs.sparkSession
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    candidates = scored(found, words)
    if len(found) > 2:
        candidates = candidates.join(inside(found), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")
    return ranked(candidates, best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
c as (select lang, sum(len(w)) as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (select unnest(range(1, {LONGEST + 1})) as k) where len(w) >= k),
f as (select lang, phrase, k, count(*) as f from g group by all having count(*) >= {LEAST}),
cut as (select lang, phrase, f as a, k, unnest(range(1, k)) as h, string_split(phrase, ' ') as w from f where k > 1),
s as (select cut.*, x.f as l, y.f as r, n, cast(({SCALE}::hugeint * cut.a::hugeint * n::hugeint) // (x.f::hugeint * y.f::hugeint) as bigint) as score from cut
  join f x on x.lang = cut.lang and x.phrase = array_to_string(w[1:h], ' ') join f y on y.lang = cut.lang and y.phrase = array_to_string(w[h + 1:], ' ') join c on c.lang = cut.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, h) as o from s),
i as (select z.lang, z.phrase from f z join f u on u.lang = z.lang and u.k > z.k and z.k > 1 and contains(' ' || u.phrase || ' ', ' ' || z.phrase || ' ') and 100 * u.f >= {INSIDE_PERCENT} * z.f),
r as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b where o = 1 and (lang, phrase) not in (select (lang, phrase) from i))
select lang, rank, phrase, a, l, r, n::bigint as n, score from r where rank <= {BEST}
"""
