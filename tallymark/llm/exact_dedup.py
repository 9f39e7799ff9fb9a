"""Exact deduplication by a Golomb-coded fingerprint exchange (operator 1).

1. Each block (a scan partition, or several where there are many) hashes its normalised
   texts, sorts the distinct 64-bit fingerprints, cuts them by owner (the leading bits)
   and sends every owner one Golomb-Rice coded list. The number of lists is that of
   blocks times owners, and a block holds about ``BLOCK_LOAD`` rows whatever the scan.
2. An owner decodes its lists and answers each block with a bitmap: which of its
   fingerprints another block holds too. Repeats inside a block are known there.
3. Documents whose fingerprint is repeated are suspects. Only their texts are
   shuffled, grouped by the bytes themselves, so that equal fingerprints of different
   texts do not make a group.

A text equals another when both are identical after lower-casing A-Z; of equal texts
the row with the largest doc_id stays.

Defined cases: null text counts as empty text; a null doc_id loses against any other;
of rows that repeat the largest doc_id and the text exactly one is kept; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ascii_lower, bounded_batches, fresh, keep_rows, staged, tidied, unstage, utf8

#: Fingerprints an owner holds at most, on average.
OWNER_LOAD = 500_000
#: Rows of a block where there are more than ``FEWEST_BLOCKS`` of them.
BLOCK_LOAD = 200_000
FEWEST_BLOCKS = 256
#: Suspect ids that may be broadcast to filter the scan of texts (8 bytes each).
BROADCAST_IDS = 500_000


def rice_parameter(n: int, span_bits: int) -> int:
    """Golomb-Rice parameter for n sorted values spread over 2**span_bits."""
    return max(0, span_bits - max(n, 1).bit_length())


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct uint64 values as Rice-coded gaps: a unary quotient, then k bits."""
    gaps = np.diff(values, prepend=np.uint64(0))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.packbits(unary).tobytes()
    return len(unary).to_bytes(8, "little") + head + np.packbits(low).tobytes()


def golomb_decode(code: bytes, n: int, k: int) -> np.ndarray:
    length = int.from_bytes(code[:8], "little")
    head = (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(code, np.uint8, head, 8))[:length]
    ends = np.flatnonzero(unary)
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.unpackbits(np.frombuffer(code, np.uint8, offset=8 + head))[: n * k].reshape(n, k).astype(np.uint64)
    tail = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((high << np.uint64(k)) | tail, dtype=np.uint64)


def _fingerprints(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        at = block << 36
        for batch in batches:
            digests = [hashlib.sha256(t.translate(ASCII_LOWER)).digest() for t in batch.column("text").to_pylist()]
            prints = np.array([int.from_bytes(d[:8], "big") & mask for d in digests], np.uint64).view(np.int64)
            n = len(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block, np.int64)), pa.array(np.arange(at, at + n)), batch.column("doc_id"), pa.array(prints), pa.array(digests, pa.binary())],
                names=["block", "row", "doc_id", "print", "digest"],
            )
            at += n

    return run


def _send(owners: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's blocks to their owners, one coded list for each owner."""
    shift = np.uint64(max(bits - owners.bit_length() + 1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            prints = batch.column("print").to_numpy().view(np.uint64)
            for b in np.unique(blocks):
                held.setdefault(int(b), []).append(prints[blocks == b])
        for b, parts in held.items():
            values = np.unique(np.concatenate(parts))
            owner = (values >> shift).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(owners + 1))
            rows = []
            for o in range(owners):
                mine = values[cuts[o] : cuts[o + 1]] - (np.uint64(o) << shift)
                if len(mine):
                    k = rice_parameter(len(mine), int(shift))
                    rows.append((o, b, len(mine), k, golomb_encode(mine, k)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["owner", "block", "n", "k", "code"])

    return run


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: bit i tells whether another block sent value i as well."""
    decoded = [golomb_decode(c, n, k) for c, n, k in zip(lists["code"], lists["n"], lists["k"])]
    values, times = np.unique(np.concatenate(decoded), return_counts=True)
    shared = values[times > 1]
    bits = [np.packbits(np.isin(d, shared, assume_unique=True)).tobytes() for d in decoded]
    return pd.DataFrame({"block": lists["block"], "owner": lists["owner"], "n": lists["n"], "bits": bits})


def _mark(prints: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    """A block's rows with its owners' answers: suspects are repeats here or elsewhere."""
    values, inverse, times = np.unique(prints["print"].to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
    ordered = bitmaps.sort_values("owner")
    answers = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(ordered["bits"], ordered["n"])]
    shared = np.concatenate(answers) if answers else np.zeros(0, np.uint8)
    if len(shared) != len(values):
        raise ValueError("a block's fingerprints and its owners' answers differ in number")
    suspect = ((times > 1) | (shared > 0))[inverse]
    return pd.DataFrame({"row": prints["row"], "doc_id": prints["doc_id"], "digest": prints["digest"], "suspect": suspect})


def group_equal(docs: DataFrame, bits: int = 64) -> DataFrame:
    """row, doc_id, text_sha256, keep_id, group_size, kept for every row of ``docs`` (doc_id, text).

    ``bits`` narrows the fingerprints, so that tests can make different texts collide.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text"))
    prints = staged(texts.mapInArrow(tidied(_fingerprints(bits)), "block long, row long, doc_id long, print long, digest binary"), "dedup-prints")
    n = prints.count()
    owners = 1 << max(6, (n // OWNER_LOAD).bit_length())
    dealt = prints.withColumn("block", F.col("block") % max(FEWEST_BLOCKS, n // BLOCK_LOAD))
    owners = min(owners, 1 << min(bits, 14))
    lists = dealt.select("block", "print").repartition(F.col("block")).mapInArrow(_send(owners, bits), "owner long, block long, n long, k long, code binary")
    bitmaps = lists.groupBy("owner").applyInPandas(_answer, "block long, owner long, n long, bits binary")
    marked = dealt.groupBy("block").cogroup(bitmaps.groupBy("block")).applyInPandas(_mark, "row long, doc_id long, digest binary, suspect boolean")
    marked = staged(marked, "dedup-marked")
    unstage([prints])

    suspects = marked.where("suspect")
    wanted = staged(suspects.select(F.col("doc_id").alias("_id")).distinct(), "dedup-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)  # else all texts are shuffled to the ids
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    normal = found.select(ascii_lower(F.col("text")).cast("binary").alias("bytes"))
    # grouping by the bytes is the verification; a digest with two texts must not happen silently
    verified = normal.groupBy("bytes").agg(F.lit(1).alias("one")).select(F.unhex(F.sha2("bytes", 256)).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_texts"))
    counts = suspects.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))
    groups = counts.join(verified, "digest").select("digest", "group_size", "best", F.when(F.col("n_texts") > 1, F.raise_error(F.lit("two texts share one SHA-256 digest"))).otherwise(F.lit(True)).alias("sound"))
    groups = staged(groups.where("sound"), "dedup-groups")  # of its own exchange, so that a hot group's rows can be split
    repeated = suspects.join(groups, "digest").select("row", "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))
    single = marked.where("not suspect").select("row", "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return repeated.unionByName(single).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of rows equal in doc_id and text one stays."""
    groups = group_equal(docs)
    kept = groups.where("kept").select("doc_id", "text_sha256")
    single = groups.where("group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()
    sha = fresh(docs, "text_sha")
    named = docs.withColumn(sha, F.sha2(ascii_lower(F.col("text")).cast("binary"), 256))
    found = keep_rows(named, kept, {"text_sha256": F.col(sha)})
    return (found if single else found.dropDuplicates(["doc_id", sha])).drop(sha)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_equal(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""
