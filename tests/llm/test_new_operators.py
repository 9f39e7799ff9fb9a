"""Collocations, filter audit and SimHash groups against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymark.llm import collocations as C
from tallymark.llm import filter_audit as A
from tallymark.llm import simhash as S

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# --- operator 11 -------------------------------------------------------------------------------


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for mark in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(mark, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.split("\n")]


def slow_collocations(rows, longest, least, best, percent=100):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = []
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [w for g, w in f if g == lang and len(w) > len(words) and f[g, w] >= least and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * f[lang, w] >= percent * a for w in longer):
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    found = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:best]
        found += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(found)


def phrase_rows(seed=1):
    rnd = random.Random(seed)
    words = ["a", "b", "ä", "New", "york", " x", "\x1cq", "of", "the"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", "\r\n"]) for _ in range(n))
    rows = [(text(rnd.randint(0, 60)), rnd.choice(["en", "fr", None, "und", ""])) for _ in range(80)]
    return rows + [(None, "en"), ("", None), ("a a a a a", "en"), ("solo", "xx"), (" \t ", "fr"), ("new york is " * 40, "en"), ("A" * 3000 + " b", "fr")] + rows[:5]


@pytest.mark.parametrize(("longest", "least", "best", "percent"), [(5, 8, 1000, 100), (3, 4, 7, 80), (2, 6, 1000, 100)])
def test_collocations(spark, longest, least, best, percent):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, "extra") for t, lang in rows], "text string, lang string, phrase string").repartition(5)
    got = sorted(tuple(r) for r in C.collocations(docs, longest, least, best, percent).collect())
    want = slow_collocations(rows, longest, least, best, percent)
    assert got == want and want


def test_collocations_without_candidates(spark):
    schema = "text string, lang string"
    assert C.collocations(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([("a b c", "en"), (None, None)], schema)
    assert C.collocations(docs).collect() == [] and C.collocations(docs, least=1).count() == 1


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """If every phrase passes the bitmap, all are counted, and the result is the same."""
    docs = spark.createDataFrame(phrase_rows(2), "text string, lang string")
    want = sorted(map(tuple, C.collocations(docs, least=6).collect()))
    monkeypatch.setattr(C, "frequent_bitmap", lambda level, n: b"\xff" * (C.LEAST_BITS // 8))
    assert sorted(map(tuple, C.collocations(docs, least=6).collect())) == want and want
    # and with as few bits as there can be
    monkeypatch.undo()
    monkeypatch.setattr(C, "MOST_BITS", C.LEAST_BITS)
    assert sorted(map(tuple, C.collocations(docs, least=6).collect())) == want


def test_places_are_cut_between_pieces(spark, monkeypatch):
    rows = phrase_rows(3)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    monkeypatch.setattr(C, "PLACES", 7)
    numbers = C._Numbers({b"\xff": 0})
    ids = C.word_numbers(["A b. c".encode(), b"", b"d"], numbers)
    assert [list(numbers)[i] for i in ids] == [b"\xff", b"a", b"b", b"\xff", b"c", b"\xff", b"\xff", b"d", b"\xff"]
    batches = list(C._count(2, None)(iter(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).toArrow().to_batches())))
    assert len(batches) > 50
    got = Counter()
    for b in batches:
        for lang, phrase, n in zip(*(b.column(c).to_pylist() for c in ("lang", "phrase", "n"))):
            got[lang, phrase.decode()] += n
    want = Counter()
    for text, lang in rows:
        for words in pieces(text):
            want.update(("und" if lang is None else lang, " ".join(p)) for p in itertools.pairwise(words))
    assert got == want


def test_scores_past_64_bits(spark):
    big = 10**13
    found = [spark.createDataFrame(r, "lang string, phrase string, f long") for r in ([("x", "a", big), ("x", "b", big - 7)], [("x", "a b", big - 9)])]
    words = spark.createDataFrame([("x", 9 * big)], "lang string, n long")
    row = C.scored(found, words).first()
    assert row["score"] == 1000 * (big - 9) * 9 * big // (big * (big - 7))


# --- operator 12 -------------------------------------------------------------------------------


def slow_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for s, f in enumerate(order):
                before = set(order[:s])
                removed = [r for r in own if f in r[1] and not r[1] & before]
                shapley[f] += len(removed)
                out[part, "".join(order), s + 1] = [
                    sum(not r[1] & (before | {f}) for r in own), len(removed), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in removed), sum(r[3] for r in removed), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]] if isinstance(row[-1], str) else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def audit_docs():
    rnd = random.Random(4)
    word = lambda: rnd.choice(["alpha", "Beta", "GAMMA", "é", "x#", "d", " "]) + str(rnd.randrange(rnd.choice([2, 500])))
    docs = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 99, 100, 130]))), rnd.choice(["en", "fr", "", None])) for i in range(120)]
    docs += [(200 + i, docs[i % 7][1], "en") for i in range(20)] + [(5, docs[5][1], "fr"), (None, docs[1][1], "en"), (None, None, None), (300, None, "fr"), (301, "", "fr"), (302, "w " * 100, "zz"), (303, "A" + "b" * 9, "zz"), (304, "AA" + "b" * 9, "zz")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 330, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_filter_audit(spark):
    docs, labels = audit_docs()
    d = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in docs], "doc_id long, text string, lang string, mask int, part string").repartition(6)
    got = A.audit(A.cells(A.failures(d), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = slow_audit(docs, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.audit(A.cells(A.failures(none), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_orders_by_single_swaps(n):
    orders = [(tuple(o), left) for o, left in A.swaps(n)]
    assert sorted(o for o, _ in orders) == sorted(itertools.permutations(range(n)))
    for (a, _), (b, left) in itertools.pairwise(orders):
        assert [i for i in range(n) if a[i] != b[i]] == [left, left + 1]


def test_only_the_swapped_steps_are_counted(monkeypatch):
    """The walk counts five steps at first and two a swap, and Shapley adds up to all removals."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, (3, 32))
    looks = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[0], slice):
                looks.append(1)
            return np.asarray(self)[key]

    rows, shapley = A.walk(counts.view(Watched), "ABCDE")
    assert len(looks) == 5 + 2 * 119 and len(rows) == 600
    assert sum(shapley) == 120 * int(counts[0, 1:].sum())


# --- operator 13 -------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            parent[root(i)] = root(int(j))
    least = {}
    for v in range(len(fps)):
        if ids[v] is not None:
            least[root(v)] = min(least.get(root(v), ids[v]), ids[v])
    return [least.get(root(v)) for v in range(len(fps))]


def test_fingerprints(spark):
    rnd = random.Random(6)
    texts = ["", None, " \t", "One", "one", "a B c", "a b c D", "ä ö ü ß é", "x " * 40_000] + [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r["fp"] % 2**64 for r in S.fingerprints(docs).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    own = docs.where("doc_id in (3, 5, 6)").select("doc_id", F.xxhash64(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("h")).collect()
    assert all(got[r["doc_id"]] == r["h"] % 2**64 for r in own)  # one shingle is its own fingerprint


def close_prints(n, seed):
    """Chains of fingerprints a few bits apart, a dense cluster, and others."""
    rnd = random.Random(seed)
    out, centre = [], rnd.getrandbits(64)
    for _ in range(n):
        kind = rnd.random()
        fp = rnd.choice(out) if out and kind < 0.5 else centre if kind < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.choice([0, 1, 3, 4, 5, 6])):
            fp ^= 1 << rnd.randrange(64)
        out.append(fp)
    return out + [0, 1, 2**64 - 1, 2**63]


@pytest.mark.parametrize(("bucket", "mean"), [(4096, 2048), (16, 2048), (50, 0.01)])
def test_links_join_what_is_close(spark, bucket, mean):
    """All groups as by comparing everything with everything: whole buckets, buckets dealt into chunks, more segments."""
    fps = sorted(set(close_prints(700, 7)))
    nodes = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long").repartition(3)
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in S.links(nodes, bucket=bucket, mean=mean).collect()]
    assert all((a ^ b).bit_count() <= 4 * 64 for a, b in edges)
    place = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(place[a])] = root(place[b])
    want = groups(fps, list(range(len(fps))))
    first = {}
    got = [first.setdefault(root(v), v) for v in range(len(fps))]
    assert got == want


def test_tables_miss_no_close_pair():
    rnd = random.Random(8)
    for mean, n in ((2048, 1000), (2048, 10**9), (2048, 10**12), (0.01, 10**12)):
        masks = S.tables(n, 4, mean)
        for _ in range(300):
            flip = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not flip & m for m in masks)
    assert len(S.tables(1000)) == 5 and len(S.tables(10**12, mean=0.01)) == 70


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 2**64, 640, dtype=np.uint64)
    fps[::3] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, len(fps[::3]), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(fps[::3]), dtype=np.uint64))
    planes = S.bit_planes(fps)
    q, w = np.repeat(fps[:90], 10), np.tile(np.arange(10), 90)
    k, near = S.close(planes, q, w, radius)
    found = np.zeros((900, 64), np.uint8)
    found[k] = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    want = np.bitwise_count(q[:, None] ^ fps.reshape(10, 64)[w]) <= radius
    assert (found.astype(bool) == want).all()


def test_groups_of_documents(spark):
    rnd = random.Random(10)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 80, 400]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 - i, t.upper()) for i, t in enumerate(base[:9])]
    for i, t in enumerate(base[10:30]):
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        rows.append((500 + i, " ".join(w)))
    rows += [(2000, None), (1999, ""), (None, base[0]), (None, "nobody else"), (3, "another text of the same number")]
    rows = [(i, t, "c") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(4)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in S.group_close(docs).collect() if r["component_id"] is not None)
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    want = sorted((i if i is not None else -1, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, groups(fps, [r[0] for r in rows])) if c is not None)
    assert got == want and len(want) == len(rows) - 1
    assert S.group_close(docs.limit(0)).count() == 0


def test_a_hot_bucket_is_dealt(spark):
    """Near copies in one bucket: every chunk pair is a key of its own, with a bounded number of rows, and links stay fewer than nodes times tables."""
    rnd = random.Random(11)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))) for _ in range(3000)}
    nodes = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    rows = S.dealt(nodes, S.tables(len(fps)), bucket=200)
    assert rows.groupBy("t", "key", "i", "j").count().agg(F.max("count")).first()[0] < 2 * 200 * 1.5
    assert S.links(nodes, bucket=200).count() < 5 * len(fps) * 15


# --- operator 6: sums of tables ----------------------------------------------------------------


@pytest.mark.parametrize("fan_in", [2, 3, 512])
def test_tables_of_many_tasks_are_added_up(spark, fan_in):
    """In one level or several, with chunks that few tasks have."""
    import zlib

    from tallymark.llm import lm_scoring as L

    rng = np.random.default_rng(12)
    packed = lambda t: zlib.compress(np.ascontiguousarray(t.view(np.uint8).reshape(-1, 8).T), 1)
    want, rows = {}, []
    for task in range(20):
        for chunk in range(5):
            if rng.random() < 0.7 or chunk == task == 0:
                t = rng.integers(0, 1 << 40, L._CHUNK * 2)
                want[chunk] = want.get(chunk, 0) + t
                rows.append((chunk, packed(t)))
    df = spark.createDataFrame(rows, "chunk int, counts binary").repartition(20)
    got = L._summed(df, fan_in).collect()
    total = {}
    for r in got:
        total[r["chunk"]] = total.get(r["chunk"], 0) + L._chunk(r["counts"])
    assert set(total) == set(want) and all((total[c] == want[c]).all() for c in want)
    assert len(got) == len(want)
    assert L._summed(df.limit(0)).count() == 0
