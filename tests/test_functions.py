"""Scalar functions, text metrics and assignment against hand-made cases and brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.functions import scalars as C
from tallymark.functions import udfs as U
from tallymark.operators import matching as M


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_timestamps(spark):
    t = spark.createDataFrame([("07:33",), ("1:02:03",), ("5s",), ("84.0s",), ("11",), ("abc",), (None,)], "t string")
    got = [tuple(r) for r in t.select(C.clock_seconds(F.col("t")), C.lenient_seconds(F.col("t")), C.strict_seconds(F.col("t"))).collect()]
    assert got == [(453, 453, 453), (3723, 3723, 3723), (None, 5, None), (None, 84, None), (None, 11, None), (None, None, None), (None, None, None)]
    assert one(spark, C.clock(F.lit(6061.9)), C.clock(F.lit(59.6), rounding=True), C.clock(F.lit(None).cast("double"))) == ("101:01", "01:00", None)
    assert one(spark, C.first_clock(F.lit("at 01:02:03 or")), C.first_clock(F.lit("none"))) == ("01:02:03", "none")


def test_chunk_borders_and_bins(spark):
    assert one(spark, *[C.at_chunk_border(F.lit(x)) for x in (28.4, 27.6, 29.0, 0.0)]) == (True, True, False, True)
    assert one(spark, *[C.tenth_bin(F.lit(x)) for x in (0.3, 0.7, 1.5, 0.0)]) == ("0.2-0.3", "0.6-0.7", "1.5+", "0.0-0.1")


def test_wire_flags(spark):
    schema = "array<struct<f: string, c: double>>"
    replies = ['{"d":[{"f":"a","c":0.5}]}', '```json\n[{"f":"b"}]\n```', '{"x":1}', "text", None]
    df = spark.createDataFrame([(r,) for r in replies], "r string").select(C.wire_flags(F.col("r"), schema).alias("d"))
    assert [[(x["f"], x["c"]) for x in r["d"]] for r in df.collect()] == [[("a", 0.5)], [("b", None)], [], [], []]


def test_script_and_cosine(spark):
    assert one(spark, C.script_share(F.lit("नमaब"), F.lit("hindi")), C.script_share(F.lit("12"), F.lit("hindi")), C.script_share(F.lit("a"), F.lit("x"))) == (0.75, None, None)
    a, z = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    got = one(spark, C.cosine(a, a), C.cosine(a, z))
    assert math.isclose(got[0], 1) and got[1] == 0


def slow_distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def test_edit_counts():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        s, d, i, m = U.edit_counts(a, b)
        assert s + d + i == slow_distance(a, b) and s + d + m == len(a) and s + i + m == len(b)
    assert U.edit_counts([], list("ab")) == (0, 0, 2, 0)


def test_text_helpers():
    assert U.shrink_repeats("x " * 9 + "end") == "x x x [x9] end"
    assert U.shrink_repeats("a b " * 8) == "a b a b a b [x8]"
    assert U.shrink_repeats("a a a b") == "a a a b"
    assert U.first_json('```json\n{"a": [1, 2]} and more') == '{"a":[1,2]}' and U.first_json("none {") is None and U.first_json(None) is None
    assert U.token_span(["ab", "cd", "ef"], "bc") == (0, 1) and U.token_span(["ab", "cd"], "cd") == (1, 1) and U.token_span(["a"], "z") is None
    assert U.normalise("A, [Inaudible] b.  3") == "A b 3"


def test_least_cost_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(120):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 9, (n, m)).astype(float)
        cost[rng.random((n, m)) < 0.3] = M.NOT_ALLOWED
        pairs = M.least_cost(cost)
        assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert math.isclose(sum(cost[r, c] for r, c in pairs), best)


def frame(rows):
    return pd.DataFrame([("m1", "f", *r) for r in rows], columns=["run_key", "file_id", "gi", "mi", "score"])


def test_assignment_rules():
    rows = [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (3, 3, 0.2)]
    assert M.greedy_pairs(frame(rows))[["gi", "mi"]].values.tolist() == [[1, 1], [3, 3]]
    assert M.best_pairs(frame(rows))[["gi", "mi"]].values.tolist() == [[1, 2], [2, 1]]
    ties = M.greedy_pairs(frame([(2, 1, 0.5), (1, 2, 0.5), (1, 1, 0.5)]))
    assert ties[["gi", "mi"]].values.tolist() == [[1, 1]]
    never = M.verified_pairs(lambda p: pd.Series([False] * len(p)))
    assert never(frame(rows)).empty
    retry = M.verified_pairs(lambda p: p["mi"] != 2)
    assert [1, 1] in retry(frame([(1, 1, 0.6), (1, 2, 0.9)]))[["gi", "mi"]].values.tolist()
    assert M.verified_pairs(lambda p: p["mi"] != 2, reference_compat=True)(frame([(1, 1, 0.6), (1, 2, 0.9)])).empty


@pytest.mark.parametrize("name", ["word_edits", "char_edits", "text_ratio", "collapse_repeats", "lenient_json"])
def test_registered(spark, name):
    U.register(spark)
    args = "'a b'" if name in ("collapse_repeats", "lenient_json") else "'a b', 'a c'"
    assert spark.sql(f"select {name}({args}) as x").count() == 1


def test_stable_shard(spark):
    import zlib

    ids = ["call_1", "", "ä-2", "x" * 500]
    got = spark.createDataFrame([(i,) for i in ids], "file_id string").select("file_id", (F.crc32(F.col("file_id").cast("binary")) % 4).alias("shard")).collect()
    assert {r["file_id"]: r["shard"] for r in got} == {i: zlib.crc32(i.encode()) % 4 for i in ids}


def test_registered_functions_by_value(spark):
    """The functions called by name from SQL."""
    U.register(spark)
    row = spark.sql(
        "select word_edits('a b c', 'a x c d') as w, char_edits('abc', 'abd') as c, text_ratio('abcd', 'bcde') as r, collapse_repeats('go go go go go go go go stop') as k, "
        "lenient_json('noise {\"a\": [1, 2]} tail') as j, token_spans(array('ab', 'cd'), 'bc') as s, token_spans(array('ab'), 'zz') as z, nfc('e\\u0301') as n"
    ).first()
    assert tuple(row["w"]) == (1, 0, 1, 2) and tuple(row["c"]) == (1, 0, 0, 2) and row["r"] == 0.75
    assert row["k"] == "go go go [x8] stop" and row["j"] == '{"a":[1,2]}' and tuple(row["s"]) == (0, 1) and row["z"]["first"] is None and row["n"] == "é"
