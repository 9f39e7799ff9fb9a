"""Operators that must hold when one key has most rows: running sums, assignment, pruned similarity, merges on disk, streams."""

import difflib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.functions import scalars, udfs
from tallymark.operators import components, documents, matching, ordered, ranking, samples
from tallymark.sources import documents as readers
from tallymark.sources import io
from tallymark.sources.versions import Conflict, VersionedTable
from tallymark.streaming import resume, sessions

# --- running sums ------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [100, 1_000_000])
def test_running_sums(spark, block):
    """Three keys, one with most rows, nulls in key and order; in blocks and as one window."""
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), None if i % 50 == 0 else rnd.randrange(400), i, rnd.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, s int, i int, n int").repartition(3)
    got = ordered.running_sums(df, ["k"], [F.col("s").desc_nulls_last(), F.col("i").asc()], ["n"], block)
    assert got.columns == ["k", "s", "i", "n", "upto_n"]
    want, total = {}, {}
    for k, s, i, n in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        total[k] = total.get(k, 0) + n
        want[i] = total[k]
    assert {r["i"]: r["upto_n"] for r in got.collect()} == want


def test_no_window_holds_a_key(spark, monkeypatch):
    """Three runs with all scores distinct: blocks stay near the set size, and the statistics are those of one window."""
    rnd = np.random.default_rng(2)
    n = 30_000
    df = spark.createDataFrame(pd.DataFrame({"run": np.repeat(["m1", "m2", "m3"], n // 3), "i": np.arange(n), "s": rnd.permutation(n) / n, "m": rnd.random(n) < 0.3}))
    totals = spark.createDataFrame([(r, 5000) for r in ("m1", "m2", "m3")], "run string, n_gt long")

    def statistics():
        positive = F.col("m")
        found = [
            ranking.auroc(df, ["run"], "s", positive), ranking.auprc(df, ["run"], "s", positive, totals),
            ranking.recall_at_fp(df, ["run"], "s", positive, totals, [10, 1000]), ranking.average_precision(df, ["run"], "s", positive, "i"),
        ]
        return [{r["run"]: [round(x, 9) for x in list(r.asDict().values())[1:]] for r in t.collect()} for t in found]

    whole = statistics()
    seen = []
    real = ordered.staged

    def watched(table, label):
        out = real(table, label)
        if label == "ordered-blocks":
            seen.append(out.groupBy("_block", "run").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ordered, "staged", watched)
    monkeypatch.setattr(ordered.running_sums, "__defaults__", (1000,))
    assert statistics() == whole
    assert len(seen) == 4 and max(seen) <= 3000


# --- assignment --------------------------------------------------------------------------------


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.getrandbits(62), rnd.getrandbits(62)) for _ in range(30)]
    path = [rnd.getrandbits(62) for _ in range(200)]
    edges += list(zip(path, path[1:])) + [(path[3], path[3]), (path[5], path[9])]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == len(parent) and len(set(got.values())) == 31
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a, b in itertools.combinations(list(got)[:150], 2))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def random_candidates(rnd, files, groups):
    """Candidates in small groups that share no flag; file f0 has most of them."""
    rows = {}
    for k in range(groups):
        f = "f0" if k % 4 else rnd.choice(files)
        for _ in range(rnd.randint(1, 7)):
            rows["m1", f, 10 * k + rnd.randrange(3), 10 * k + rnd.randrange(3)] = round(rnd.random(), 3)
    return [(*key, s) for key, s in rows.items()]


def best_total(pairs):
    """Most pairs, then the greatest total, by trying all of a small group."""
    best = (0, 0.0)
    for k in range(1, len(pairs) + 1):
        for some in itertools.combinations(pairs, k):
            if len({p[2] for p in some}) == k == len({p[3] for p in some}):
                best = max(best, (k, sum(p[4] for p in some)))
    return best


def test_hot_file_is_spread_and_best(spark):
    rows = random_candidates(random.Random(4), ["f0", "f1", None], 60)
    df = spark.createDataFrame(rows, matching.PAIR_SCHEMA).repartition(4)
    everything = lambda scores: matching.best_pairs(scores, least=0.0)
    cold = sorted(map(tuple, matching.assign(df, everything).collect()), key=str)
    hot = sorted(map(tuple, matching.assign(df, everything, hot=20).collect()), key=str)
    assert hot == cold
    by_group = {}
    for r in rows:
        by_group.setdefault((r[1], r[2] // 10), []).append(r)
    got = {}
    for r in hot:
        got.setdefault((r[1], r[2] // 10), []).append(r)
    for key, pairs in by_group.items():
        n, total = best_total(pairs)
        assert len(got[key]) == n and abs(sum(p[4] for p in got[key]) - total) < 1e-9
    for how in (matching.greedy_pairs, matching.verified_pairs(lambda p: (p["gi"] + p["mi"]) % 3 > 0)):
        one = sorted(map(tuple, matching.assign(df, how).collect()), key=str)
        assert one == sorted(map(tuple, matching.assign(df, how, hot=20).collect()), key=str)


def test_file_of_100_000_candidates(spark):
    """One file, 25,000 groups of four candidates: many tasks settle it, and every group gets its two pairs."""
    rows = spark.range(25_000).selectExpr("'m1' as run_key", "'f' as file_id", "id", "explode(array(0, 1, 2, 3)) as k")
    rows = rows.selectExpr("run_key", "file_id", "id * 2 + k % 2 as gi", "id * 2 + k div 2 as mi", "case when k in (0, 3) then 0.9D else 0.5D end as score")
    seen = matching.assign(rows, lambda scores: matching.best_pairs(scores)).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        by_task = {r["task"]: r["count"] for r in seen.groupBy("task").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(by_task.values()) == 50_000 and len(by_task) == 4 and max(by_task.values()) < 20_000
    assert matching.assign(rows).where("gi <> mi or score <> 0.9").count() == 0


def test_native_text_helps_only_in_its_script(spark):
    row = "run_key string, file_id string, language string, category string, event_id long, t_sec int, vec array<float>, excerpt string"
    gt = spark.createDataFrame([(None, "f", "hindi", "x", 1, 10, [1.0, 0.0], "क ख ग घ"), (None, "f", "hindi", "x", 2, 10, [1.0, 0.0], "abc"), (None, "f", "hindi", "x", 3, 40, [0.0, 0.0], None)], row)
    flags = spark.createDataFrame([("m", "f", "hindi", "x", 11, 12, [-1.0, 0.0], "क ख ग घ"), ("m", "f", "hindi", "x", 12, 12, [-1.0, 0.1], "abc"), ("m", "f", "hindi", "y", 13, 56, [0.0, 1.0], "क")], row)
    plain = {(r["gi"], r["mi"]) for r in matching.scored_candidates(gt, flags).collect()}
    native = {(r["gi"], r["mi"]): r["score"] for r in matching.scored_candidates(gt, flags, native=True).collect()}
    # 56 s is a chunk border: flag 13 meets all; vectors of no length have the cosine 0
    assert plain == {(3, 11), (3, 12), (1, 13), (2, 13), (3, 13)}
    assert set(native) == plain | {(1, 11)} and abs(native[1, 11] - min(1.0, 0.7 + 0.3 * np.exp(-2 / 20) + 0.15)) < 1e-12


# --- similarity of texts -----------------------------------------------------------------------


def test_bounds_are_never_below_the_ratio(spark):
    rnd = random.Random(5)
    texts = ["", None, "क ख", "aab", "x" * 300] + ["".join(rnd.choice("abc क😀") for _ in range(rnd.randrange(12))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", scalars.ratio_bound_by_length(F.col("a"), F.col("b")).alias("n"), scalars.ratio_bound_by_letters(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        m = difflib.SequenceMatcher(None, r["a"] or "", r["b"] or "")
        assert r["n"] == m.real_quick_ratio() and r["c"] == m.quick_ratio() and m.ratio() <= r["c"] <= r["n"]
    cands = df.withColumn("i", F.monotonically_increasing_id())
    kept = matching.prematched(cands, F.col("a"), F.col("b"), 0.5)
    want = sum(difflib.SequenceMatcher(None, a or "", b or "").ratio() >= 0.5 for a, b in pairs)
    assert kept.count() == want < matching.possible_matches(cands, F.col("a"), F.col("b"), 0.5).count() < len(pairs)


def slow_shrink(text, keep=3, least=8, longest=4):
    """The rule word by word: of the runs that begin here, the widest, of equals the shortest phrase."""
    words, out = text.split(), []
    while words:
        runs = []
        for size in range(1, longest + 1):
            n = 1
            while words[n * size : (n + 1) * size] == words[:size] and len(words) >= (n + 1) * size:
                n += 1
            if n >= least and len(words) >= size:
                runs.append((-n * size, size, n))
        if runs:
            _, size, n = min(runs)
            out += [*words[: keep * size], f"[x{n}]"]
            words = words[n * size :]
        else:
            out.append(words.pop(0))
    return " ".join(out)


def test_repeats_by_the_rule():
    rnd = random.Random(6)
    for _ in range(300):
        text = " ".join(" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) + f" {' '.join([rnd.choice(['a', 'a b', 'a b a', 'c c'])] * rnd.randint(1, 14))}" for _ in range(rnd.randint(0, 4)))
        assert udfs.shrink_repeats(text) == slow_shrink(text)
        assert udfs.shrink_repeats(text, keep=1, least=3, longest=2) == slow_shrink(text, 1, 3, 2)


# --- merges on disk ----------------------------------------------------------------------------

ROWS = "run_key string, file_id string, event_id long, note string"


def table(spark, folder):
    return VersionedTable(spark, f"file://{folder}/t", spark.createDataFrame([], ROWS).schema, buckets=4)


def content(kept, version=None):
    return sorted((r["run_key"], r["file_id"], r["event_id"], r["note"]) for r in kept.read(version).collect())


def test_versions(spark, tmp_path, monkeypatch):
    kept = table(spark, tmp_path)
    assert content(kept) == [] and kept.versions() == []
    first = [(f"m{i % 3}", f"f{i % 7}", i, "old") for i in range(60)]
    assert kept.merge(spark.createDataFrame(first, ROWS), ["run_key"], "a") == 1 and content(kept) == sorted(first)
    # a merge by file rewrites the parts of that run and bucket only, and keeps their other rows
    before = set(kept._listed(1)["parts"].items())
    new = [("m1", "f1", 1, "new")]
    assert kept.merge(spark.createDataFrame(new, ROWS), ["run_key", "file_id"], "b") == 2
    assert content(kept) == sorted([r for r in first if r[:2] != ("m1", "f1")] + new)
    assert content(kept, 1) == sorted(first)
    assert len(before - set(kept._listed(2)["parts"].items())) == 1
    # the same commit again does nothing
    assert kept.merge(spark.createDataFrame(new, ROWS), ["run_key", "file_id"], "b") == 2 and kept.versions() == [1, 2]
    # a write that breaks off before its list is written leaves the table as it was; running it again makes it whole
    whole = content(kept)
    late = spark.createDataFrame([("m2", "f2", 2, "late")], ROWS)
    with monkeypatch.context() as m:
        m.setattr(kept, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.merge(late, ["run_key"], "c")
    assert content(kept) == whole and kept.versions() == [1, 2]
    assert kept.merge(late, ["run_key"], "c") == 3
    assert content(kept) == sorted([r for r in whole if r[0] != "m2"] + [("m2", "f2", 2, "late")])
    with pytest.raises(Conflict):  # another writer was faster
        kept._commit(3, {"parts": {}, "commits": {}})
    whole = content(kept)
    kept.forget(1)
    assert kept.versions() == [3] and content(kept) == whole
    with pytest.raises(ValueError, match="run_key"):
        kept.merge(late, ["file_id"], "d")


def test_versions_take_odd_names(spark, tmp_path):
    kept = table(spark, tmp_path)
    rows = [("a/b=c %", "f 1", 1, None), ("ä", None, 2, "x"), ("__x", "", 3, "y")]
    kept.merge(spark.createDataFrame(rows, ROWS), ["run_key"], "a")
    kept.merge(spark.createDataFrame([("ä", None, 5, "z")], ROWS), ["run_key", "file_id"], "b")
    assert sorted(map(str, (tuple(r) for r in kept.read().collect()))) == sorted(map(str, [rows[0], rows[2], ("ä", None, 5, "z")]))


def test_annotations_on_disk(spark, tmp_path):
    kept = table(spark, tmp_path)
    kept.merge(spark.createDataFrame([("m", "f", 1, None), ("m", "f", 2, None), ("m", "g", 3, "was"), ("n", "h", 4, None)], ROWS), ["run_key"], "a")
    notes = spark.createDataFrame([("m", "f", 1, "x"), ("m", "f", 2, "y"), ("m", "g", 3, "z"), ("m", "g", 9, "more")], ROWS)
    kept.annotate(notes, ["run_key", "file_id", "event_id"], ["note"], "n1")
    assert [(r[2], r[3]) for r in sorted(content(kept), key=lambda r: r[2])] == [(1, "x"), (2, "y"), (3, "was"), (4, None)]


def test_listing_passes_over_other_folders(spark, tmp_path):
    for p in ("hindi_pm/TP/Single/a.mp3", "hindi_pm/FP/b.wav", "tamil_pm/TP/d.mp3", "tamil_fn/c.MP3"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    files = lambda *a: [r["file_id"] for r in io.dataset_files(spark, str(tmp_path), *a).collect()]
    assert files() == ["b", "a", "c", "d"] and files(["tamil"]) == ["c", "d"] and files(None, ["TP"]) == ["a", "d"]
    assert files(["tamil"], ["FN"]) == ["c"] and files(["telugu"]) == []
    assert [f.rsplit("/", 2)[-1] for f in io._folders(spark, str(tmp_path), ["hindi"], ["FP"])] == ["FP"]


# --- streams -----------------------------------------------------------------------------------


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def arrive(*times):
        spark.createDataFrame([(t, "x") for t in times], "ts string, event_type string").selectExpr("cast(ts as timestamp) as ts", "event_type").coalesce(1).write.mode("append").parquet(source)
        resume.append_stream(resume.windowed_counts(spark.readStream.schema(schema).parquet(source)), out, mark)
        return {r["window"]["start"].strftime("%H:%M:%S"): r["n"] for r in spark.read.parquet(out).collect()}

    assert arrive("2024-01-01 00:00:10", "2024-01-01 00:00:20") == {}
    assert arrive("2024-01-01 00:00:30", "2024-01-01 00:20:00") == {"00:00:00": 3}
    # later than the watermark allows: dropped; within it: counted when the window closes
    assert arrive("2024-01-01 00:00:40", "2024-01-01 00:19:55", "2024-01-01 00:40:00") == {"00:00:00": 3, "00:19:30": 2}
    assert sorted(arrive("2024-01-01 01:00:00").values()) == [1, 2, 3]


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 7], [5, 6]])
def test_sessions_over_any_split(spark, tmp_path, cuts):
    """The calls do not depend on where the log is cut; a load discards the open call, also across a cut."""
    kinds = "c l c c l l c c c"
    lines = [(u, 10 * u + i, float(i + (i > 6)), k == "l") for u in (1, 2) for i, k in enumerate(kinds.split()[u - 1 :])]
    lines.append((2, 99, lines[-1][2], False))  # no time has passed: no call
    schema = "user_id long, event_id long, sec double, is_load boolean"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    edges = [-1, *cuts, 100]
    for a, b in itertools.pairwise(edges):
        spark.createDataFrame([r for r in lines if a < r[2] <= b], schema).coalesce(1).write.mode("append").parquet(source)
        resume.append_stream(sessions.session_stream(spark.readStream.schema(schema).parquet(source)), out, mark)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = []
    for u in (1, 2):
        own, run = sorted((r for r in lines if r[0] == u), key=lambda r: (r[2], r[1])), 0
        for now, after in zip(own, own[1:]):
            run += now[3]
            if run and not now[3] and not after[3] and after[2] > now[2]:
                want.append((u, now[1], run, after[2] - now[2]))
    assert got == sorted(want) and want


# --- batches, quotas, reports ------------------------------------------------------------------


def batches_of(spark, n):
    """One file with n flags, of which every second one is matched and every tenth one judged."""
    flags = spark.range(n).selectExpr("'m' as run_key", "'f' as file_id", "id as flag_idx", "'PlatformMove' as category", "id % 2 = 0 as matched")
    verdicts = spark.range(0, n, 10).selectExpr("'m' as run_key", "'f' as file_id", "id + 1 as flag_idx", "'t' as taxonomy_version", "'h' as prompt_hash")
    return documents.audit_batches(flags, verdicts, "t", "h")


def test_batches_grow_with_the_flags(spark, tmp_path):
    sizes = {}
    for n in (1000, 10_000):
        batches_of(spark, n).write.option("compression", "none").parquet(str(tmp_path / str(n)))
        sizes[n] = sum(f.stat().st_size for f in (tmp_path / str(n)).glob("*.parquet"))
        row = spark.read.parquet(str(tmp_path / str(n))).first()
        assert len(row["flags"]) == n and row["todo"] == [i for i in range(n) if i % 2 and i % 10 != 1]
    assert sizes[10_000] < 12 * sizes[1000]
    items = documents.work_items(batches_of(spark, 50))
    assert items.count() == 20 and items.where("size(other_flags) <> 49 or category <> 'PlatformMove'").count() == 0


def test_quotas_with_substitution(spark):
    """Against a choice by hand over all files; unmet slots are filled as long as any file of the sign is left."""
    rnd = random.Random(7)
    counts = {"p1": 1, "p2": 2, "n1": 2, "n2": 1}
    rows = []
    for lang, n in (("a", 40), ("b", 5), ("c", 3), (None, 4)):
        for i in range(n):
            positive = rnd.random() < 0.5 and lang != "c"
            fits = [s for s in counts if (s[0] == "p") == positive and rnd.random() < (0.6 if lang == "a" else 0.3)]
            rows.append((lang, f"{lang}{i}", positive, fits, rnd.randrange(4)))
    df = spark.createDataFrame(rows, "lang string, file string, positive boolean, fits array<string>, place int").repartition(3)
    slots = [samples.Slot(s, n, s[0] == "p", F.array_contains("fits", s)) for s, n in counts.items()]
    got = samples.by_quota(df, "lang", "file", F.col("positive"), slots, [F.col("place"), F.col("file")]).collect()
    names = list(counts)
    for lang in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (r[4], r[1]))
        left, want, empty = list(own), set(), []
        for s, n in counts.items():
            hits = [r for r in left if s in r[3]][:n]
            want |= {(r[1], s, False) for r in hits}
            left = [r for r in left if r not in hits]
            empty += [s] * (n - len(hits))
        for s in empty:
            same = [r for r in left if r[2] == (s[0] == "p")]
            same.sort(key=lambda r: (min([(abs(names.index(x) - names.index(s)), names.index(x)) for x in r[3]] or [(9, -1)]), r[4], r[1]))
            if same:
                want.add((same[0][1], s, True))
                left.remove(same[0])
        assert {(r["file"], r["slot"], r["substituted"]) for r in got if r["lang"] == lang} == want
    assert all(("from" in r["reason"]) == r["substituted"] for r in got) and len({r["file"] for r in got}) == len(got)
    assert samples.by_quota(df.limit(0), "lang", "file", F.col("positive"), slots, [F.col("file")]).count() == 0


def test_report_of_several_tables(spark, tmp_path):
    one, two = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int"), spark.createDataFrame([(0.5,)], "x double")
    lines = io.report_lines([("First", one, ["k"]), ("Second", two, ["x"])])
    io.write_report(lines, str(tmp_path / "r"))
    text = "".join(f.read_text() for f in (tmp_path / "r").glob("part-*"))
    assert text == "## First\n\n| k | n |\n| --- | --- |\n| a |  |\n| b | 2 |\n\n## Second\n\n| x |\n| --- |\n| 0.5 |\n"


def test_prompt_files(spark, tmp_path):
    (tmp_path / "prompt_v3.txt").write_text("plain\n{x}")
    (tmp_path / "prompt_v8.py").write_text('TEXT = """Judge\nthe call"""\n\n\ndef get_prompt():\n    return TEXT\n')
    (tmp_path / "other.py").write_text("def get_prompt():\n    return 'direct'\n")
    got = sorted((r["name"], r["version"], r["text"]) for r in readers.read_prompts(spark, str(tmp_path)).collect())
    assert got == [("other.py", None, "direct"), ("prompt_v3.txt", "v3", "plain\n{x}"), ("prompt_v8.py", "v8", "Judge\nthe call")]


def test_a_frozen_set_is_not_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "file string, place int")
    io.write_once(rows, str(tmp_path / "v1"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        io.write_once(rows, str(tmp_path / "v1"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "v1")).collect()[0]["place"] == "1"
