"""SimHash near-dedup by bit-sliced comparison (operator 13).

A text's fingerprint has a bit set if over half of the 64-bit hashes of its 4-word shingles,
repeats included, have it set. Fingerprints that differ in at most 4 bits are linked, and a
group is a connected component of links.

1. Rows with the same fingerprint are one node, so copies cost nothing further.
2. The 64 bits are cut into s segments. Two fingerprints with at most 4 differing bits agree
   in at least s - 4 segments, so comparing the nodes that share a choice of s - 4 segments
   (a bucket) misses no link. More nodes ask for more segments: 5 and their 5 tables of
   12-bit keys suffice up to millions, 8 with 70 tables of 32-bit keys for any number.
3. A bucket of more than ``BUCKET`` nodes is dealt into chunks by a hash of the fingerprint,
   and each pair of chunks is compared by itself, so a bucket of any size is many tasks.
4. In a bucket, bit planes are stored vertically: one machine word holds the same bit of 64
   fingerprints. A fingerprint meets such a word of 64 at once: each plane's differences are
   added to 64 distances that lie in three bit-sliced counters with a carry out that sticks,
   and after every few planes the words in which all 64 distances exceed the radius are
   abandoned, which most are after a third of the planes.
5. From the links of a bucket only a spanning forest leaves the task (fewer links than
   nodes), and the components of all forests are the groups.

Defined cases: a null or empty text, or one of blanks only, has fingerprint zero and is
linked like any other; with fewer than four words the whole sequence is the one shingle; a
bit set in exactly half of the hashes is 0; rows that repeat a doc_id have each their own
text's fingerprint; a component with null doc_ids only has a null component_id; texts of any
length are read whole, in blocks of shingles; an empty table gives an empty result; columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, read, staged, tidied, utf8
from .near_dedup import components

WIDTH = 4
SEED = 42
RADIUS = 4
#: Shingles of a text that are hashed at once.
SHINGLES = 32_768
#: Nodes of a bucket that are compared in one piece, about; larger buckets are dealt into chunks of that size.
BUCKET = 4_096
#: Mean nodes a bucket, above which more segments are taken.
MEAN = 2_048
#: Rows that one task compares, about, and that it holds at once.
TASK_ROWS = 400_000
HELD_ROWS = 50_000
#: Words of 64 fingerprints that meet a fingerprint, held at once.
MEETINGS = 32_768
#: Hot buckets that may be broadcast (about 20 bytes each); beyond that they are joined.
BROADCAST_BUCKETS = 100_000
#: Planes between two looks at which words can be abandoned.
LOOK_EVERY = 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def fingerprint(text: bytes) -> int:
    """64-bit fingerprint of the shingles of a text in UTF-8."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - WIDTH + 1)
    starts, ends = starts[:n], ends[min(WIDTH, len(words)) - 1 :]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        spans = zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())
        h = np.array([hashed(joined[i:j], SEED) for i, j in spans], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def tables(nodes: int, radius: int = RADIUS, mean: int = MEAN) -> list[int]:
    """Masks of the bits that the tables' keys keep: every choice of segments in which close fingerprints must agree."""
    for segments in range(radius + 1, radius + 5):
        bounds = [64 * i // segments for i in range(segments + 1)]
        masks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(bounds[:-1], bounds[1:])]
        kept = segments - radius
        fewest = sum(sorted(m.bit_count() for m in masks)[:kept])
        if nodes >> fewest <= mean:
            break
    return [sum(choice) for choice in combinations(masks, kept)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def dealt(nodes: DataFrame, masks: list[int], bucket: int = BUCKET) -> DataFrame:
    """Rows (t, key, i, j, side, fp) of what is compared: a bucket, or chunk i with chunk j of a large one; ``side`` tells them apart."""
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > bucket).select("t", "key", F.ceil(F.col("count") / bucket).cast("int").alias("chunks"))
    hot = staged(hot, "simhash-hot")
    few = hot.count() <= BROADCAST_BUCKETS
    sized = keyed.join(F.broadcast(hot) if few else hot, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = sized.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    met = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("c") > F.col("o"), 1).otherwise(0)
    return met.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), side.alias("side"), "fp")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of the fingerprints (a multiple of 64 of them): word w of plane b has bit b of fingerprints 64 w to 64 w + 63."""
    planes = np.empty((64, len(fps) // 64), np.uint64)
    for b in range(64):
        planes[b] = np.packbits(((fps >> np.uint64(b)) & _ONE).astype(np.uint8), bitorder="little").view(np.uint64)
    return planes


def close(planes: np.ndarray, fps: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprint fps[k] and the 64 of word[k], which are within the radius: the k with any, and their bits."""
    size = radius.bit_length()
    at, mine = np.arange(len(fps)), fps
    counters = [np.zeros(len(fps), np.uint64) for _ in range(size + 1)]  # the last one sticks
    for b in range(64):
        carry = planes[b][word] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & _ONE))
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        counters[size] |= carry
        if b % LOOK_EVERY == LOOK_EVERY - 1:
            far, equal = counters[size].copy(), ~counters[size]
            for k in range(size - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    far |= equal & counters[k]
                    equal &= ~counters[k]
            alive = far != _ALL
            if b == 63:
                return at[alive], ~far[alive]
            if np.count_nonzero(alive) < 0.8 * len(alive):
                at, mine, word = at[alive], mine[alive], word[alive]
                counters = [c[alive] for c in counters]
    raise AssertionError


def join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of each group) after linking the places a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label[np.maximum(x, y)] = np.minimum(x, y)
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above


def forest(fps: np.ndarray, first: np.ndarray, lanes: np.ndarray, radius: int = RADIUS, meetings: int = MEETINGS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of what lies within the radius, group by group; places of both ends.

    Group g is fps[first[g]:first[g + 1]]; its fingerprints before lanes[g] meet those from lanes[g]
    on, or each other if lanes[g] is first[g].
    """
    size = first[1:] - lanes
    words = (size + 63) // 64
    at_word = np.concatenate([[0], np.cumsum(words)])
    # lanes, padded to whole words
    place = np.full(int(at_word[-1]) * 64, -1)
    of = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    place[at_word[of] * 64 + inside] = lanes[of] + inside
    used = np.packbits(place >= 0, bitorder="little").view(np.uint64)
    planes = bit_planes(np.where(place >= 0, fps[place], np.uint64(0)))
    # the words that every fingerprint meets: the rest of its group, or all of the other side
    group = np.repeat(np.arange(len(size)), np.diff(first))
    row = np.arange(len(fps))
    within = lanes[group] == first[group]
    begin = np.where(within, at_word[group] + (row - first[group] + 1) // 64, at_word[group])
    meets = np.where(within | (row < lanes[group]), np.maximum(at_word[group + 1] - begin, 0), 0)
    row, begin, meets = row[meets > 0], begin[meets > 0], meets[meets > 0]
    upto = np.cumsum(meets)
    label = np.arange(len(fps))
    start = 0
    while start < len(row):
        done = upto[start] - meets[start]
        end = max(start + 1, int(np.searchsorted(upto, done + meetings, "right")))
        n = meets[start:end]
        q = np.repeat(row[start:end], n)
        w = np.repeat(begin[start:end], n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        k, near = close(planes, fps[q], w, radius)
        q, w = q[k], w[k]
        bits = np.unpackbits((near & used[w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, lane = np.nonzero(bits)
        a, b = q[hit], place[w[hit] * 64 + lane]
        label = join_up(label, a, b)
        start = end
    tail = np.flatnonzero(label != np.arange(len(fps)))
    return tail, label[tail]


_DEALT = ["t", "key", "i", "j"]


def _linked(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning links (a, b) of the groups of sorted rows (t, key, i, j, side, fp)."""

    def settle(held: list[tuple[np.ndarray, ...]], whole: bool) -> tuple[pa.RecordBatch | None, list[tuple[np.ndarray, ...]]]:
        columns = [np.concatenate(c) for c in zip(*held)]
        keys, side, fp = columns[:4], columns[4], columns[5]
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        end = len(fp) if whole else int(new[-1])  # the last group may go on
        rest = [] if whole else [tuple(c[end:] for c in columns)]
        if not end:
            return None, rest
        first = np.append(new if whole else new[:-1], end)
        fps, one = fp[:end].view(np.uint64), (side[:end] == 0).astype(np.int64)
        firsts = np.add.reduceat(one, first[:-1])
        lanes = first[:-1] + np.where(keys[2][first[:-1]] == keys[3][first[:-1]], 0, firsts)
        a, b = forest(fps, first, lanes, radius)
        x, y = fp[a], fp[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in [*_DEALT, "side", "fp"]))
            if sum(len(h[0]) for h in held) >= HELD_ROWS:
                found, held = settle(held, False)
                if found is not None:
                    yield found
        if held:
            found, _ = settle(held, True)
            if found is not None:
                yield found

    return run


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, mean: int = MEAN) -> DataFrame:
    """Links (a, b) between fingerprints (fp) that join all that lie within the radius of each other into their components."""
    spark = nodes.sparkSession
    n = nodes.count()
    masks = tables(n, radius, mean)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // TASK_ROWS))
    rows = dealt(nodes, masks, bucket).repartition(parts, *_DEALT).sortWithinPartitions(*_DEALT, "side")
    return rows.mapInArrow(tidied(_linked(radius)), "a long, b long").distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (fp, 64 bits as a signed long) of every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(tidied(_fingerprints), "doc_id long, fp long")


def group_close(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, mean: int = MEAN) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs`` (doc_id, text)."""
    prints = staged(fingerprints(docs), "simhash-prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    bounded_batches(docs.sparkSession, 20_000)
    edges = staged(links(nodes.select("fp"), radius, bucket, mean), "simhash-links")
    roots = nodes.withColumn("root", F.col("fp"))
    if not edges.isEmpty():
        of = components(edges)
        roots = nodes.join(of, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = roots.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return group_close(read(spark, sf_dir, "documents"))
