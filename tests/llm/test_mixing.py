"""Pfair mixing against a slot-by-slot simulation."""

import random
from collections import Counter
from fractions import Fraction

from tallymark.llm import mixing


def test_period_keeps_every_window_and_lag():
    rnd = random.Random(3)
    for _ in range(40):
        weights = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        slots, total = mixing.pfair_period(weights), sum(weights)
        assert sorted(s for lane in slots for s in lane) == list(range(total))
        for w, lane in zip(weights, slots):
            for j, s in enumerate(lane):
                assert j * total // w <= s < -(-(j + 1) * total // w)
            for t in range(total + 1):
                assert abs(sum(s < t for s in lane) - Fraction(t * w, total)) < 1


def test_phases_use_every_block_once():
    weights, blocks = [5, 3, 1], [7, 40, 2]
    seen = Counter()
    taken = set()
    for _, lane, w, q, a, b, first, slots in mixing.phases(weights, blocks):
        for j in range(b - a):
            slot = first + j // w * q + slots[j % w]
            assert slot not in taken
            taken.add(slot)
            seen[lane] += 1
    assert [seen[i] for i in range(3)] == blocks
    assert taken == set(range(sum(blocks)))


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot int, mixed_id string")


def test_every_row_has_a_place(spark):
    rows = [(i, "x" * (i % 50 * 40), "en", f"s{i % 3}" if i % 3 else "hot", None, 1, "c") for i in range(300)]
    rows += [(900, None, None, None, None, 1, "c"), (901, "", "en", "s1", None, 1, "c"), (902, "y" * 9000, "en", "s2", None, 1, "c"), (None, "n", "en", "s1", None, 1, "c"), (5, rows[5][1], "en", "s2", None, 1, "c")]
    out = mixing.mix(make(spark, rows), {"hot": 3, "s1": 2}, block_chars=500).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((r[0], r[3]) for r in rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    assert len({r["slot"]: 0 for r in out}) <= len({(r["source"], r["block"]) for r in out})
    slot_owner = {}
    for r in out:
        assert slot_owner.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert {r["weight"] for r in out if r["source"] == "hot"} == {3}


def test_order_keeps_rows_and_columns(spark):
    rows = [(i, "x" * 100, "en", "ab"[i % 2], 100, i, "c") for i in range(50)] + [(7, "x" * 100, "en", "b", 100, 7, "c")]
    docs = make(spark, rows)
    out = mixing.in_mixed_order(docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))


def test_empty(spark):
    docs = make(spark, [])
    assert mixing.mix(docs).count() == 0
    assert mixing.in_mixed_order(docs).count() == 0


def test_sources_of_equal_weight_and_size_share_a_lane(spark):
    rows = [(i, "x" * 100, "en", f"s{i}", 100, i, "c") for i in range(20)]
    out = mixing.mix(make(spark, rows), block_chars=100).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(20)) and sorted(r["slot"] for r in out) == list(range(20))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)


def lag(slots, t, share):
    return abs(sum(s < t for s in slots) - t * share)


def test_given_weights_are_kept_by_every_source(spark):
    """Ten sources of 60 blocks each, of three weights: each is less than one block from its share at any time."""
    rows = [(i * 10 + k, "x" * 100, "en", f"s{k}", 100, i, "c") for k in range(10) for i in range(60)]
    given = {f"s{k}": 6 if k == 9 else 3 if k < 5 else 4 for k in range(10)}
    out = mixing.mix(make(spark, rows), given, block_chars=100).collect()
    assert {(r["source"], r["weight"]) for r in out} == set(given.items())
    slots = {s: [r["slot"] for r in out if r["source"] == s] for s in given}
    total = sum(given.values())
    for t in range(1, min(map(max, slots.values())) + 2):
        for s, w in given.items():
            assert lag(slots[s], t, w / total) < 1, (t, s)
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)


def test_five_thousand_sources(spark):
    """A hot source and 5,000 others of several sizes: until a lane has empty turns, every source is less than one block from its share."""
    from pyspark.sql import functions as F

    n, block = 5000, 100
    m = F.expr("cast(case when k = 0 then 1600 when k % 50 = 1 then 5 when k % 7 = 1 then 3 else 1 end as int)")
    docs = spark.range(n).withColumnRenamed("id", "k").withColumn("i", F.explode(F.sequence(F.lit(1), m)))
    docs = docs.select((F.col("k") * 10_000 + F.col("i")).alias("doc_id"), F.concat(F.lit("s"), "k").alias("source"), F.repeat(F.lit("x"), F.lit(block)).alias("text"))
    out = mixing.mix(docs, block_chars=block).toPandas()
    assert len(out) == docs.count() and (out["release"] <= out["slot"]).all() and (out["slot"] < out["deadline"]).all()
    first = out[out["phase"] == 0]
    lanes = mixing._in_lanes(mixing._weighed(docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars")), None), block).collect()
    sized = Counter((r["weight"], r["rounds"]) for r in lanes)
    assert len(sized) <= 8
    each = sorted(sized)
    weights = mixing._plan([{"weight": w, "rounds": r, "n": sized[w, r]} for w, r in each], None)[1]
    share = {r["source"]: weights[each.index((r["weight"], r["rounds"]))] / sized[r["weight"], r["rounds"]] / sum(weights) for r in lanes}
    end = int(first["slot"].max())
    got = {s: sorted(g["slot"].unique()) for s, g in first.groupby("source")}
    for s, w in share.items():
        slots = got.get(s, [])
        # the lag is largest just before and at a source's slots, and at the end
        for j, t in enumerate(slots):
            assert abs(j - t * w) < 1 and abs(j + 1 - (t + 1) * w) < 1, (s, j, t)
        assert abs(len(slots) - end * w) < 1 + 1e-9, s


def test_the_driver_does_not_follow_the_number_of_sources():
    """Lanes come from grids of weights and sizes; ten times the sources are the same lanes, and the same schedule."""
    rnd = random.Random(5)

    def lanes(n):
        sizes = [int(1.5 ** (rnd.random() * 30)) + 1 for _ in range(n)]
        grid = lambda x, up: ((x - 1 >> max(0, x.bit_length() - 3)) + 1 if up else x >> max(0, x.bit_length() - 3)) << max(0, x.bit_length() - 3)
        found = Counter((grid(max(1, int(s**0.5)), False), grid((s - 1) // 20_000 + 1, True)) for s in sizes)
        return [{"weight": w, "rounds": r, "n": k} for (w, r), k in sorted(found.items())]

    few, many = lanes(2_000), lanes(200_000)
    assert len(many) < 100 and len(many) < 1.5 * len(few)
    plan, each = mixing._plan(many, None)
    assert sum(each) < 1.1 * mixing.PARTS + len(many) and sum(len(p[-1]) for p in plan) < len(many) * 2 * mixing.PARTS


def test_grids(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 3000).select("id", mixing.rounded_down(F.col("id")).alias("d"), mixing.rounded_up(F.col("id")).alias("u")).collect()
    for r in rows:
        assert r["d"] <= r["id"] <= r["u"] and 4 * r["d"] > 3 * r["id"] - 4 and 4 * r["u"] <= 5 * r["id"]
        assert len(bin(r["d"]).rstrip("0")) <= 5 and len(bin(r["u"]).rstrip("0")) <= 5
    assert [r["d"] for r in rows[:8]] == [1, 2, 3, 4, 5, 6, 7, 8] and rows[8]["d"] == 8 and rows[8]["u"] == 10


def test_place_replaces_columns_of_that_name(spark):
    docs = spark.createDataFrame([(1, "a", "s", "mine", "too"), (2, "b", "s", "mine", "too")], "doc_id long, text string, source string, slot string, order_key string")
    out = mixing.in_mixed_order(docs, with_place=True)
    assert out.columns == ["doc_id", "text", "source", "slot", "order_key"] and {r["slot"] for r in out.collect()} == {0}
    assert mixing.in_mixed_order(docs).columns == docs.columns


def test_rows_deviate_less_than_a_block(spark):
    """Characters of real rows: each source is within two blocks (a block and the document that leaves it) of its share."""
    rnd = random.Random(8)
    rows = [(i, "x" * rnd.randint(1, 200), "en", "abc"[min(2, rnd.randrange(6) // 2)], 0, i, "c") for i in range(600)]
    weights = {"a": 5, "b": 3, "c": 2}
    out = mixing.mix(make(spark, rows), weights, block_chars=500).collect()
    first = [r for r in out if r["phase"] == 0]
    for t in range(1, max(r["slot"] for r in first) + 1):
        for s, w in weights.items():
            slots = {r["slot"] for r in first if r["source"] == s and r["slot"] < t}
            assert abs(len(slots) - t * w / 10) < 1 + 1e-9


def test_too_long_a_period_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        mixing.mix(make(spark, [(1, "a", "en", "a", 1, 1, "c"), (2, "a", "en", "b", 1, 1, "c")]), {"a": 1_000_003, "b": 7})


def test_pipeline_returns_the_mixed_order(spark):
    import corpus_pipeline
    from tallymark.llm import mixing
    from tallymark.llm.common import staged

    rows = [(i, f"text {i} " * (1 + i % 90 * 40), f"s{i % 3}") for i in range(300)] + [(None, "none", "s1"), (7, "again", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mixed = staged(corpus_pipeline.mixing_stage(spark, docs, ""), "test-mixed")
    assert len(mixed.inputFiles()) > 1
    got = corpus_pipeline.encoding_stage(spark, mixed, "").orderBy("slot", "order_key", "doc_id").collect()
    at = {}
    for r in mixing.mix(docs).collect():
        at[r["doc_id"]] = min(at.get(r["doc_id"], (r["slot"], r["order_key"])), (r["slot"], r["order_key"]))
    assert len(got) == len(rows) and len({r["slot"] for r in got}) > 3
    assert all((r["slot"], r["order_key"]) == at[r["doc_id"]] for r in got)
