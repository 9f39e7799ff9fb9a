"""Edge cases of confusion, thresholds, rankings and sources; property checks over random flags."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import asr, confusion, ranking, scoring, thresholds, timing
from tallymark.sources import io
from tallymark.streaming import resume

FLAG = "run_key string, file_id string, language string, category string, confidence double, matched boolean, matched_gt_category string, fp_type string, entropy_mean double"


def tables(spark, flags, gt, files):
    f = spark.createDataFrame([("m", i, "tamil") for i in files], "run_key string, file_id string, language string")
    return f, spark.createDataFrame(gt, "file_id string, category string"), spark.createDataFrame([("m", i, "tamil", c, s, m, g, t, None) for i, c, s, m, g, t in flags], FLAG)


def test_file_buckets(spark):
    files, gt, flags = tables(spark, [("a", "PlatformMove", None, True, "PlatformMove", None), ("c", "PlatformMove", 0.2, False, None, None)], [("a", "PlatformMove"), ("b", "PlatformMove")], "abcd")
    got = {r["file_id"]: r["file_bucket"] for r in confusion.per_file(files, gt, flags).collect()}
    assert got == {"a": "TP", "b": "FN", "c": "FP", "d": "TN"}


def test_sweep_edges(spark):
    """Missing scores pass only without a threshold; strict follows the reference flag's category, loose the model's."""
    files, gt, flags = tables(spark, [("a", "PlatformMove", None, True, "SuspiciousActivity", None), ("b", "other", 0.9, False, None, "DUPLICATE_OR_EXTRA_INSTANCE")], [("a", "SuspiciousActivity")], "abc")
    got = {(r["category"], r["threshold"]): r for r in thresholds.sweep(files, gt, flags, "confidence", [0.5], keys=("run_key",), all_keys=()).collect()}
    assert (got["ALL", None]["tp"], got["ALL", 0.5]["tp"], got["ALL", 0.5]["fn"]) == (1, 0, 1)
    assert (got["SuspiciousActivity", None]["tp"], got["SuspiciousActivity", None]["loose_tp"]) == (1, 0)
    assert (got["ALL", 0.5]["fp"], got["ALL", 0.5]["tn"], got["ALL", 0.5]["flag_redundant"], got["ALL", 0.5]["flag_fp"]) == (1, 1, 1, 0)
    assert got["Explicit-Flirting", 0.5]["recall"] is None and got["PlatformMove", None]["n_missing"] == 1


def test_random_flags_keep_invariants(spark):
    rnd = random.Random(2)
    cats = [*scoring.CATEGORIES, "Not a violation"]
    files = [f"f{i}" for i in range(40)]
    gt = [(rnd.choice(files[:25]), rnd.choice(cats[:3])) for _ in range(40)]
    flags = []
    for _ in range(150):
        i, c, m = rnd.choice(files), rnd.choice(cats), rnd.random() < 0.4
        flags.append((i, c, rnd.choice([None, round(rnd.random(), 1)]), m, rnd.choice(cats[:3]) if m else None, None))
    t = thresholds.sweep(*tables(spark, flags, gt, files), "confidence", thresholds.TENTHS)
    assert t.where("tp + fn <> n_gt_pos or fp + tn <> n_gt_neg").count() == 0
    assert thresholds.rises(t, ["run_key", "language", "category"]).count() == 0


def test_scoring_rules(spark):
    rows = [("v1", None, 0.9, "x", None, None), ("v6", None, 0.9, "PlatformMove", None, None), ("v6", "direct", 0.9, "PlatformMove", "unclear", None), ("v4", "direct", 0.9, "other", None, "no"), ("v6", "direct", None, "PlatformMove", None, "yes")]
    df = spark.createDataFrame(rows, "prompt string, speech_act string, confidence double, category string, speaker string, violation string")
    got = [(r["score_raw"], r["score_sa"], r["score_pp_full"], r["dropped"]) for r in scoring.with_modes(df).collect()]
    assert got == [(0.9, 0.9, 0.9, True), (0.9, 0.3, 0.3, False), (0.9, 0.3, 0.3, False), (0.9, 0.9, 0.3, True), (None, 0.0, 0.0, False)]
    with pytest.raises(Exception, match="unknown prompt version"):
        scoring.with_modes(df.withColumn("prompt", F.lit("v99"))).collect()
    same = scoring.post_process(df, "none").where("pp_confidence is distinct from confidence or pp_dropped")
    assert same.count() == 0


def test_rankings(spark):
    rows = [("k", 0.9, True), ("k", 0.5, True), ("k", 0.5, False), ("k", None, False), ("one", 0.1, True)]
    df = spark.createDataFrame(rows, "k string, s double, m boolean")
    got = {r["k"]: r["auroc"] for r in ranking.auroc(df, ["k"], "s", F.col("m")).collect()}
    assert got == {"k": 3.5 / 4, "one": None}
    totals = spark.createDataFrame([("k", 4), ("one", 1)], "k string, n_gt long")
    ap = {r["k"]: r["auprc"] for r in ranking.auprc(df, ["k"], "s", F.col("m"), totals).collect()}
    assert abs(ap["k"] - (0.25 * 1 + 0.25 * 2 / 3)) < 1e-12
    b = {r["k"]: r["recall_at_0_fp"] for r in ranking.recall_at_fp(df, ["k"], "s", F.col("m"), totals, [0]).collect()}
    assert b == {"k": 0.25, "one": 1.0}


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c", "a c"), ("", "x"), ("a", "b c d")], "ref string, hyp string")
    assert [r["wer"] for r in asr.word_error_rate(df).collect()] == [1 / 3, None, 3.0]
    segs = spark.createDataFrame([(1, 0.0, 40.0), (1, 15.0, 40.0), (2, 0.0, 40.0)], "k long, start_s double, duration_s double")
    got = {r["k"]: (r["n_boundaries"], r["n_corrupted"]) for r in asr.boundary_corruption(segs, "k", 15.0).collect()}
    assert got == {1: (2, 1), 2: (2, 0)}


def test_sessions(spark):
    lines = [(1, 1, 0.0, "x"), (1, 2, 1.0, "load"), (1, 3, 2.0, "call"), (1, 4, 5.0, "call"), (1, 5, 6.0, "load"), (1, 6, 7.0, "call")]
    df = spark.createDataFrame(lines, "user long, event_id long, sec double, kind string")
    got = [(r["event_id"], r["seconds"]) for r in timing.sessions(df, "user", F.col("kind") == "load").collect()]
    assert got == [(3, 3.0)]


def test_sources(spark, tmp_path):
    for p in ("hindi_pm/TP/Single/a.mp3", "hindi_pm/FP/b.wav", "tamil_fn/c.MP3", "tamil_fn/notes.txt"):
        (tmp_path / "set" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / p).write_bytes(b"x")
    got = [(r["file_id"], r["language"], r["category"], r["original_bucket"], r["multiplicity"]) for r in io.dataset_files(spark, str(tmp_path / "set")).collect()]
    assert got == [("b", "hindi", "pm", "FP", None), ("a", "hindi", "pm", "TP", "Single"), ("c", "tamil", None, "FN", None)]
    df = spark.createDataFrame([("m1", 1), ("m2", 2)], "model string, v long")
    io.write_csv(df, str(tmp_path / "csv"), ["v", "model"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["v", "model"]
    io.append_json(df, str(tmp_path / "j"))
    io.append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert sorted(map(tuple, io.keyed_merge(df, spark.createDataFrame([("m2", 9)], "model string, v long"), ["model"]).collect())) == [("m1", 1), ("m2", 9)]
    assert io.markdown(df.orderBy("v")) == "| model | v |\n| --- | --- |\n| m1 | 1 |\n| m2 | 2 |"
    with pytest.raises(ValueError):
        io.markdown(df, limit=1)


def test_incremental_ingestion(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for _ in range(2):
        df.coalesce(1).write.mode("append").json(source)
        resume.ingest_new(spark, source, df.schema, sink, mark)
    assert spark.read.parquet(sink).count() == 2


def test_registry_is_complete():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
