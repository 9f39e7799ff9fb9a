"""Matching, alignment, rounding and document operators against plain Python."""

import difflib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.functions import scalars, udfs
from tallymark.operators import documents, matching
from tallymark.sources import documents as readers
from tallymark.streaming import resume


def full_table_edits(ref, hyp):
    """The whole distance table and the same preference on the way back."""
    n, m = len(ref), len(hyp)
    t = [[i + j if not (i and j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    s = d = ins = match = 0
    i, j = n, m
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            match, i, j = match + 1, i - 1, j - 1
        elif i and j and t[i][j] == t[i - 1][j - 1] + 1:
            s, i, j = s + 1, i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, d, ins, match


def test_alignment_with_kept_rows_equals_the_whole_table():
    rnd = random.Random(1)
    for _ in range(300):
        ref = [rnd.choice("abc") for _ in range(rnd.randint(0, 30))]
        hyp = [rnd.choice("abc") for _ in range(rnd.randint(0, 30))]
        assert udfs.edit_counts(ref, hyp) == full_table_edits(ref, hyp)


def test_alignment_of_long_texts_needs_little_memory():
    import tracemalloc

    rnd = random.Random(2)
    ref = [rnd.randrange(50) for _ in range(4_000)]
    hyp = [w for w in ref if rnd.random() > 0.1]
    tracemalloc.start()
    s, d, i, m = udfs.edit_counts(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s + d + m == len(ref) and s + i + m == len(hyp) and peak < 16 << 20


def flags_of(rnd, n, files):
    return [(i, rnd.choice(files), rnd.choice(["A", "B"]), rnd.randrange(400)) for i in range(n)]


def test_pairs_near_in_time_equal_brute_force(spark):
    rnd = random.Random(3)
    gt, flags = flags_of(rnd, 120, ["f", "g", "h"]), [(1000 + i, f, c, t) for i, f, c, t in flags_of(rnd, 200, ["f", "g", "x"])]
    g = spark.createDataFrame(gt, "event_id long, file_id string, category string, t_sec int")
    f = spark.createDataFrame([("m", *r) for r in flags], "run_key string, event_id long, file_id string, category string, t_sec int")
    for seconds in (0, 15, 60):
        want = {(a[0], b[0]) for a in gt for b in flags if a[1] == b[1] and abs(a[3] - b[3]) <= seconds}
        got = [(r["gi"], r["mi"]) for r in matching.near_pairs(g, f, seconds).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    content = F.expr("(gi * 31 + mi * 17) % 100 / 100.0D")
    border = lambda t: t % 28 <= 0.5 or 28 - t % 28 <= 0.5
    want = {(a[0], b[0]) for a in gt for b in flags if a[1] == b[1] and (border(b[3]) or abs(a[3] - b[3]) <= 60) and (a[0] * 31 + b[0] * 17) % 100 >= 50}
    got = [(r["gi"], r["mi"]) for r in matching.scored_candidates(g, f, content).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_mutual_pairs_are_one_to_one(spark):
    rnd = random.Random(4)
    pairs = {(rnd.randrange(20), rnd.randrange(20)): rnd.randrange(5) for _ in range(120)}
    df = spark.createDataFrame([("m", "f", a, b, c) for (a, b), c in pairs.items()], "run_key string, file_id string, gi long, mi long, delta int")
    of_g = {g: min((c, m) for (a, m), c in pairs.items() if a == g)[1] for g, _ in pairs}
    of_m = {m: min((c, g) for (g, b), c in pairs.items() if b == m)[1] for _, m in pairs}
    got = {(r["gi"], r["mi"]) for r in matching.mutual_pairs(df, ["delta"]).collect()}
    assert got == {(g, m) for g, m in pairs if of_g[g] == m and of_m[m] == g} and got


def test_groupwise_assignment_has_the_best_total():
    """Against all assignments of a small file; groups of candidates that share no flag."""
    rnd = random.Random(5)
    for _ in range(60):
        pairs = {(rnd.randrange(4), 10 + rnd.randrange(4)): round(0.5 + rnd.random() / 2, 3) for _ in range(rnd.randint(1, 9))}
        frame = pd.DataFrame([("m", "f", g, m, s) for (g, m), s in pairs.items()], columns=["run_key", "file_id", "gi", "mi", "score"])
        got = matching.best_pairs(frame)
        assert got["gi"].is_unique and got["mi"].is_unique
        best = (0, 0.0)
        for k in range(1, 5):
            for chosen in itertools.combinations(pairs, k):
                if len({g for g, _ in chosen}) == k == len({m for _, m in chosen}):
                    best = max(best, (k, round(sum(pairs[c] for c in chosen), 6)))
        assert (len(got), round(got["score"].sum(), 6)) == best


def test_rounding_equals_python(spark):
    rnd = random.Random(6)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.005, 0.285, 1e6 + 0.125, 0.0, -0.0, 5e-324, None]
    values += [rnd.uniform(-1000, 1000) for _ in range(2000)] + [k / 8 for k in range(-400, 400)] + [k / 1000 for k in range(-3000, 3000, 5)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.round_half_even(F.col("v")).alias("r"), scalars.round_half_even(F.col("v"), 1000).alias("r3")).collect()
    for r in got:
        if r["v"] is None:
            assert r["r"] is None
        else:
            assert r["r"] == round(r["v"], 2) and r["r3"] == round(r["v"], 3), r["v"]


def test_prematch_by_likeness(spark):
    pairs = spark.createDataFrame([("m", "f", 1, 2, "abcd", "abcx"), ("m", "f", 1, 3, "abcd", "zzzz")], "run_key string, file_id string, gi long, mi long, a string, b string")
    got = [(r["mi"], r["similarity"]) for r in matching.prematched(pairs, F.col("a"), F.col("b"), 0.5).collect()]
    assert got == [(2, difflib.SequenceMatcher(None, "abcd", "abcx").ratio())]


def test_resumed_replies(spark):
    seg = lambda *ts: [{"t": t, "en": t} for t in ts]
    rows = [(1, [seg("00:05", "00:10"), seg("00:07", "00:12", "00:11"), seg("00:11", "00:20")]), (2, [seg(), seg("00:01")]), (3, [])]
    df = spark.createDataFrame(rows, "id int, replies array<array<struct<t: string, en: string>>>")
    got = {r["id"]: [s["t"] for s in r["kept"] or []] for r in df.select("id", documents.resumed(F.col("replies")).alias("kept")).collect()}
    assert got[1] == ["00:05", "00:10", "00:12", "00:11", "00:20"] and got[2] == ["00:01"]


def test_polymorphic_transcripts(spark):
    rows = ['{"segments": []}', '{"transcript": {"utterances": [{"timestamp": 3.5, "transcript": "x", "spk": "A"}]}}', '{"transcript": ["one", "two"]}', '{"transcript": "all of it"}', "not json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r["i"]: [(s["t_sec"], s["text"]) for s in r["s"] or []] for r in df.select("i", documents.polymorphic_segments(F.col("raw")).alias("s")).collect()}
    assert got == {0: [], 1: [(3.5, "A: x")], 2: [(None, "one"), (None, "two")], 3: [(None, "all of it")], 4: [], 5: []}


def test_snr_by_numpy(spark):
    rng = np.random.default_rng(7)
    sound = {"a": rng.normal(size=103) * 0.1, "short": rng.normal(size=30)}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in sound.items() for i, v in enumerate(vs)], "id string, i long, amplitude double")
    files = spark.createDataFrame([("a",), ("short",), ("none",)], "id string")
    got = {r["id"]: r["snr_db"] for r in documents.snr_table(files, documents.frame_levels(df, "id", 8), "id").collect()}
    frames = sound["a"][:96].reshape(12, 8)
    db = 20 * np.log10(np.sqrt((frames**2).mean(axis=1) + 1e-12) + 1e-12)
    assert abs(got["a"] - (np.percentile(db, 90) - np.percentile(db, 10))) < 1e-9 and got["short"] is None and got["none"] is None


def test_stage_tables(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, "t", "success", "x"), ("g", 2, "u", "error", "x"), (None, 3, "v", "success", "x")], "file_id string, t_sec int, text string, status string, more string")
    rows.write.json(f"{tmp_path}/in")
    got = readers.read_stage(spark, f"{tmp_path}/in", "transcription")
    assert got.columns == ["file_id", "t_sec", "text"] and [tuple(r) for r in got.collect()] == [("f", 1, "t")]
    with pytest.raises(ValueError):
        readers.read_stage(spark, f"{tmp_path}/in", "nothing")


def test_windowed_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:10' + make_interval(0, 0, 0, 0, 0, 0, id * 20) as ts, if(id % 2 = 0, 'a', 'b') as event_type from range(6)")
    got = {(str(r["window"]["start"])[-8:], r["event_type"]): r["n"] for r in resume.windowed_counts(df).collect()}
    assert got == {("00:00:00", "a"): 1, ("00:00:00", "b"): 1, ("00:00:45", "a"): 1, ("00:00:45", "b"): 1, ("00:01:30", "a"): 1, ("00:01:30", "b"): 1}


def test_running_report_counts_once(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("k", StringType())])
    report = lambda: {r["k"]: r["n"] for r in resume.running_report(spark, f"{tmp_path}/in", schema, ["k"], f"{tmp_path}/out", f"{tmp_path}/check").collect()}
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.json(f"{tmp_path}/in")
    assert report() == {"a": 2, "b": 1} == report()
    spark.createDataFrame([("a",), ("c",)], "k string").write.mode("append").json(f"{tmp_path}/in")
    assert report() == {"a": 3, "b": 1, "c": 1}


def test_context_lines_equal_their_sql(spark, tmp_path):
    """Excerpts with line breaks, tabs or missing; missing texts, turns and conversations; turns before the start."""
    import duckdb

    from tallymark.plans import registry

    rnd = random.Random(35)
    long = "x" * 301
    rows = [(1, 0, "one two\nthree " + long), (1, 1, "three is no two"), (1, 2, "here two\nthree is"), (2, 0, "a b\tcde " + long), (2, 1, "cde"), (2, 9, "zz")]
    rows += [(3, 0, long), (4, 0, long), (4, 4, "no-blank"), (5, 0, None), (6, 4, None), (6, None, "late one " + long), (None, 0, "n o"), (7, 0, "ab cd " + long), (7, 1, None), (8, -1, "early"), (8, -5, "far early " + long), (9, 0, "  " + long), (10, 700, "very late"), (11, 4, None), (11, 0, "q qrs " + long)]
    for conv in range(100, 220):
        turns = rnd.sample(range(-2, 9), rnd.randint(1, 6)) + [None] * (rnd.random() < 0.1)
        text = lambda: None if rnd.random() < 0.1 else "".join(rnd.choice(["ab", "abc", "bcd", " ", " ", "\n", "\t", "\u00a0", "é", "𝒳"]) for _ in range(rnd.choice([0, 1, 5, 30, 200])))
        rows += [(conv, t, text()) for t in turns]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["sc35_context_lines"]).fetchall()
    got = [tuple(r) for r in registry.queries()["sc35_context_lines"](spark, str(tmp_path)).select("conv_id", "context").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({c for c, _ in want}) == len(want) > 90
