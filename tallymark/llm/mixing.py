"""Mixing sources to target weights by Pfair scheduling (operator 3), DataFrame functions only.

A source's documents, in a pseudo-random order, are cut into blocks of ``block_chars``
characters. Sources of the same weight that have about as many blocks (to three binary digits)
form a lane, whose weight is the sum of theirs; so there are few lanes, a few for each octave of
sizes, however many sources there are. The lane weights of those not yet used up add to Q.
Block j of a lane of weight w may run from slot floor(j Q / w) and has to have run by slot
ceil((j + 1) Q / w); in each slot the released block with the earliest deadline runs. On one
processor this meets every window. Inside a lane its n sources take turns, always in the same
order, so block j of source i is block j n + i of the lane.

After any number t of slots of a phase a lane has had less than one block more or less than
t w / Q, and a source less than 1 - 1/n from its n-th part of what the lane has had; so every
source, whatever their number, is less than one block from its share. The schedule repeats after
Q slots, so one period per phase is computed from the lane weights alone and applied to all
blocks by arithmetic. When a lane is used up a new phase begins with the weights of the others.
A source that ends before the others of its lane, which is in the lane's last quarter, leaves its
turns empty: their slots are not used, and the others go on at their pace. No row is dropped or
repeated.

Without given weights a source weighs as the square root of its characters, to three binary
digits, and lane weights are taken in parts of ``PARTS`` (one at least). With them, sources
that are not named weigh 1, lane weights are exact and, after division by common factors, may
add up to ``MAX_PERIOD``. Either way the driver's work and what is broadcast depend on the
octaves of sizes and weights and not on the number of sources.

Numbering needs no source and no lane in one task: rows (and sources) are dealt into ranges of
a hash, numbered inside (source, range), and lifted by the sums of the ranges before.

Defined cases: null text counts as one character, as does empty text; null sources
form a source of their own; a document longer than a block takes the slot of the block it begins
in; repeated rows are mixed each, and in ``in_mixed_order`` rows that repeat a doc_id
stand together at the first's place; an empty table gives an empty result; extra
columns are ignored or, in ``in_mixed_order``, kept (but for slot and order_key, which
``with_place`` replaces).
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, staged

BLOCK_CHARS = 20_000
#: A period's slots: about so many by default, and the most that given weights may ask for.
PARTS = 2_000
MAX_PERIOD = 20_000
#: Binary digits to which weights and numbers of blocks are told apart.
DIGITS = 3
RANGE_ROWS = 2_000
SOURCE_RANGES = 1_024
#: Sources that may be broadcast to the rows (about 60 bytes each); beyond that they are joined.
BROADCAST_SOURCES = 50_000
#: Characters of a partition in the mixture's order, about.
PART_CHARS = 64_000_000


def pfair_period(weights: list[int]) -> list[list[int]]:
    """For each lane its slots in one period, by earliest deadline first over released blocks."""
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, lane) for lane in range(len(weights))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, lane = heapq.heappop(waiting)
            j = len(slots[lane])
            heapq.heappush(ready, (-((-(j + 1) * total) // weights[lane]), lane))
        _, lane = heapq.heappop(ready)
        slots[lane].append(t)
        j = len(slots[lane])
        if j < weights[lane]:
            heapq.heappush(waiting, (j * total // weights[lane], lane))
    return slots


def phases(weights: list[int], blocks: list[int]) -> list[tuple]:
    """(phase, lane, weight, total, first_block, end_block, first_slot, slots of a period) for every lane and phase."""
    left, used, at, out, number = dict(enumerate(blocks)), [0] * len(blocks), 0, [], 0
    left = {lane: n for lane, n in left.items() if n > 0}
    while left:
        active = sorted(left)
        total = sum(weights[lane] for lane in active)
        slots = dict(zip(active, pfair_period([weights[lane] for lane in active])))
        ends = {}
        for lane in active:
            cycle, k = divmod(left[lane] - 1, weights[lane])
            ends[lane] = cycle * total + slots[lane][k] + 1
        length = min(ends.values())
        cycles, rest = divmod(length, total)
        for lane in active:
            n = cycles * weights[lane] + sum(s < rest for s in slots[lane])
            out.append((number, lane, weights[lane], total, used[lane], used[lane] + n, at, slots[lane]))
            used[lane] += n
            left[lane] -= n
        left = {lane: n for lane, n in left.items() if n > 0}
        at += length
        number += 1
    return out


def _shift(number: Column) -> Column:
    """The binary digits of a positive number beyond the first ``DIGITS``."""
    return F.greatest(F.lit(0), F.length(F.bin(number)) - DIGITS)


def rounded_down(number: Column) -> Column:
    return F.call_function("shiftleft", F.call_function("shiftright", number, _shift(number)), _shift(number))


def rounded_up(number: Column) -> Column:
    low = rounded_down(number)
    return F.when(low == number, low).otherwise(low + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(number)))


def _weighed(sizes: DataFrame, weights: dict | None) -> DataFrame:
    """The sources (source, chars) with their weights."""
    if weights is None:
        return sizes.withColumn("weight", rounded_down(F.greatest(F.lit(1), F.floor(F.sqrt(F.col("chars").cast("double")))).cast("long")))
    if any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("target weights are positive integers")
    given = sizes.sparkSession.createDataFrame([(s, int(w)) for s, w in weights.items()], "_s string, weight long")
    return sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))


def _in_lanes(sources: DataFrame, block_chars: int) -> DataFrame:
    """The sources with rounds (their blocks, rounded up: with the weight, the lane) and their turn in the lane, from 0."""
    lane = ["weight", "rounds"]
    blocks = F.expr(f"(chars - 1) div {block_chars} + 1")
    hashed = sources.withColumn("rounds", rounded_up(blocks)).withColumn("h", F.xxhash64("source", F.lit(11)))
    ranged = hashed.withColumn("r", F.shiftrightunsigned("h", 64 - SOURCE_RANGES.bit_length() + 1))
    count = ranged.groupBy(*lane, "r").count()
    before = count.select(*[F.col(c).alias(f"_{c}") for c in (*lane, "r")], (F.sum("count").over(W.partitionBy(*lane).orderBy("r")) - F.col("count")).alias("before"))
    inside = F.row_number().over(W.partitionBy(*lane, "r").orderBy("h", "source"))
    same = (F.col("weight") == F.col("_weight")) & (F.col("rounds") == F.col("_rounds")) & (F.col("r") == F.col("_r"))
    return ranged.withColumn("i", inside).join(before, same).select("source", "chars", "weight", "rounds", (F.col("before") + F.col("i") - 1).alias("turn"))


def _plan(lanes: list, weights: dict | None) -> tuple[list[tuple], list[int]]:
    """The phases of the lanes (weight, rounds, n), and the lanes' scheduled weights."""
    each = [r["weight"] * r["n"] for r in lanes]
    if weights is None:
        total = sum(each)
        each = [max(1, round(PARTS * w / total)) for w in each]
    common = gcd(*each) if each else 1
    each = [w // common for w in each]
    if weights is not None and sum(each) > MAX_PERIOD:
        raise ValueError(f"the target weights of all sources add up to more than {MAX_PERIOD}")
    return phases(each, [r["rounds"] * r["n"] for r in lanes]), each


def mix(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, source, its weight, phase, lane block, release, deadline, slot and order_key of every row.

    Reading the rows by (slot, order_key, doc_id) gives the mixture.
    """
    return _mixed(docs, weights, block_chars)[0]


def _mixed(docs: DataFrame, weights: dict | None, block_chars: int) -> tuple[DataFrame, int]:
    """The rows of ``mix`` and the characters of all documents."""
    spark = docs.sparkSession
    chars = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    base = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), chars.alias("chars"), F.xxhash64(F.col("doc_id").cast("long")).alias("order_key")), "mix-base")
    sizes = base.groupBy("source").agg(F.sum("chars").alias("chars"))
    sources = staged(_in_lanes(staged(_weighed(sizes, weights), "mix-sizes"), block_chars), "mix-sources")
    lanes = sources.groupBy("weight", "rounds").agg(F.count("*").alias("n")).orderBy("weight", "rounds").collect()  # a few for each octave
    plan, each = _plan(lanes, weights)
    table = spark.createDataFrame(
        [(p, lanes[i]["weight"], lanes[i]["rounds"], lanes[i]["n"], w, q, a, b, s, list(slots)) for p, i, w, q, a, b, s, slots in plan],
        "phase int, _weight long, _rounds long, n long, lane_weight long, total long, first_block long, end_block long, first_slot long, slots array<int>",
    )
    n_rows, n_chars = base.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    ranges = min(65_536, max(64, n_rows // RANGE_ROWS + 1))
    ranged = base.withColumn("range", F.expr(f"cast(shiftright(shiftrightunsigned(order_key, 32) * {ranges}L, 32) as int)"))
    sums = staged(ranged.groupBy("source", "range").agg(F.sum("chars").alias("chars")), "mix-sums")
    before = sums.select(F.col("source").alias("_s"), F.col("range").alias("_r"), (F.sum("chars").over(W.partitionBy("source").orderBy("range")) - F.col("chars")).alias("before"))
    inside = W.partitionBy("source", "range").orderBy("order_key", "doc_id", "chars").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = ranged.withColumn("upto", F.sum("chars").over(inside)).join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).drop("_s", "_r")
    of_source = sources.select(F.col("source").alias("_s"), "weight", "rounds", "turn")
    of_source = F.broadcast(of_source) if sources.count() <= BROADCAST_SOURCES else of_source
    placed = numbered.withColumn("own", F.expr(f"(before + upto - chars) div {block_chars}")).join(of_source, F.col("source").eqNullSafe(F.col("_s")))
    in_lane = placed.join(F.broadcast(table), (F.col("weight") == F.col("_weight")) & (F.col("rounds") == F.col("_rounds"))).withColumn("block", F.expr("own * n + turn"))
    at = in_lane.where("block >= first_block and block < end_block")
    j = "(block - first_block)"
    found = at.select(
        "doc_id", "source", "weight", "phase", "block",
        F.expr(f"first_slot + {j} * total div lane_weight").alias("release"),
        F.expr(f"first_slot - (-(({j} + 1) * total) div lane_weight) + case when (({j} + 1) * total) % lane_weight = 0 then 0 else 1 end").alias("deadline"),
        F.expr(f"first_slot + {j} div lane_weight * total + element_at(slots, cast({j} % lane_weight as int) + 1)").alias("slot"),
        "order_key",
    )
    return found, n_chars


def in_mixed_order(docs: DataFrame, weights: dict | None = None, with_place: bool = False) -> DataFrame:
    """The documents, range-partitioned by size and sorted in the mixture's order.

    Readers of several files may take them in another order; ``with_place`` adds the
    columns slot and order_key (and replaces such columns of ``docs``), by which (then doc_id)
    the rows are in the mixture's order.
    """
    if with_place:
        docs = docs.drop("slot", "order_key")
    name, place = fresh(docs, "mixed_id"), fresh(docs, "mixed_at")
    mixed, chars = _mixed(docs.select("doc_id", "text", "source"), weights, BLOCK_CHARS)
    at = mixed.groupBy(F.col("doc_id").alias(name)).agg(F.min(F.struct("slot", "order_key")).alias(place))
    placed = docs.join(at, F.col("doc_id").eqNullSafe(F.col(name)))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    return placed.repartitionByRange(parts, place, name).sortWithinPartitions(place, name).select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(f"{place}.slot"), F.col(f"{place}.order_key")] if with_place else []))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
