"""Exact and near deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import exact_dedup as E
from tallymark.llm import near_dedup as N

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(text):
    return (text or "").encode().translate(LOWER)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, bits in ((1, 64), (500, 58), (3000, 16), (2, 3)):
        values = np.unique(rng.integers(0, 2 ** min(bits, 63), n, dtype=np.uint64))
        k = E.rice_parameter(len(values), bits)
        assert (E.golomb_decode(E.golomb_encode(values, k), len(values), k) == values).all()


def rows_exact():
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["Alpha", "alpha", "ALPHA beta", "äÄ", "Ää", "x" * 50_000, "", None, f"own {i}"]), f"s{i}") for i in range(400)]
    return rows + [(7, rows[7][1], "again"), (None, "alpha", "n"), (None, "only null", "n")]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, bits):
    """With 3-bit fingerprints most texts collide, and only the bytes tell them apart."""
    rows = rows_exact()
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    out = E.group_equal(docs, bits=bits).collect()
    assert len(out) == len(rows)
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    by_sha = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in out:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_drop_keeps_columns(spark):
    rows = rows_exact()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    out = E.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [normal(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({normal(r[1]) for r in rows})
    assert E.drop_copies(docs.limit(0)).count() == 0 and E.group_equal(docs.limit(0)).count() == 0


def shingles(text):
    words = normal(text).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = root(i), root(j)
                parent[max(r, s)] = min(r, s)
    return {i: (len(s), root(i)) for i, s in sets}


def near_rows():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(6, 120))]
        for _ in range(rnd.choice([1, 1, 2, 5, 30])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((i, (" \t\n"[i % 3]).join(words) if i % 2 else " ".join(words).upper()))
            i += 1
    passage = " ".join(rnd.choice(vocabulary) for _ in range(40))
    rows += [(1000 + k, passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(60))) for k in range(40)]
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b c"), (2004, "A B  C"), (2005, "a b"), (2006, "z " * 30_000)]


def test_near_components_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, comp long, id string").repartition(3)
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.group_near(docs).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (9, text), (None, text), (None, "other words than those above here"), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in N.group_near(docs).collect() if r["n_shingles"] != 2)
    assert got == [(-1, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert N.group_near(docs.limit(0)).count() == 0


def test_components_beyond_one_task(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(50)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a long, b long").distinct()
    few = {r["v"]: r["root"] for r in N.components(df, local_edges=5).collect()}
    one = {r["v"]: r["root"] for r in N.components(df).collect()}
    assert few == one


def nodes_of(rows):
    """Node rows (id, comp, n_shingles, sig, prefix) of texts, each its own component; shingles of four texts or more come last."""
    words = N._WordHashes()
    sets = {i: N.shingle_set(normal(text), words) for i, text in rows}
    values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    common, rank = values[counts >= 4], np.argsort(np.argsort(counts[counts >= 4], kind="stable"), kind="stable")
    return [(i, i, len(s), bytearray(N._min_hashes([s])[0].tobytes()), bytearray(N.prefix(s, common, rank).tobytes())) for i, s in sets.items()]


NODE = "id long, comp long, n_shingles long, sig binary, prefix binary"


def test_hot_group_costs_no_square(spark):
    """800 near copies of one text: candidates grow with their number, and none are left once they are linked."""
    words = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join(words[:-1] + [f"v{i}"])) for i in range(800)]
    nodes = spark.createDataFrame(nodes_of(rows), NODE)
    assert N.candidates(nodes, N.FIRST_ORDERS, 1, []).count() <= N.FIRST_ORDERS * 800
    linked = nodes.withColumn("comp", F.lit(1).cast("long"))
    assert N.candidates(linked, N.ORDERS, N.REACH, []).count() == 0 and N.exact_candidates(linked).count() == 0
    got = N.group_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.count_distinct("component_id")).first()[0] == 1


def test_common_passage_costs_no_square(spark):
    """600 texts that share a long passage and are not similar: few pairs, of 179,700, are compared."""
    rnd = random.Random(12)
    passage = [f"p{i}" for i in range(140)]
    rows = [(k, " ".join(passage + [f"u{k}_{j}" for j in range(rnd.randint(50, 70))])) for k in range(600)]
    nodes = spark.createDataFrame(nodes_of(rows), NODE)
    assert N.candidates(nodes, N.ORDERS, N.REACH, []).count() <= 2 * N.REACH * N.ORDERS * 600
    assert N.exact_candidates(nodes).count() <= 600


def test_parities_never_rule_out_a_link():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        n = int(rnd.integers(1, 400))
        both = rnd.integers(0, 2**63, n, dtype=np.uint64)
        x = np.unique(np.concatenate([both, rnd.integers(0, 2**63, int(rnd.integers(0, n // 4 + 2)), dtype=np.uint64)]))
        y = np.unique(np.concatenate([both, rnd.integers(0, 2**63, int(rnd.integers(0, n // 4 + 2)), dtype=np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= N.PERCENT * (len(x) + len(y) - inter):
            assert N.may_reach(*(np.frombuffer(N.parities(s).tobytes(), np.uint8) for s in (x, y)), len(x), len(y))
    far = [np.unique(rnd.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2)]
    assert not N.may_reach(N.parities(far[0]), N.parities(far[1]), 500, 500)


def passage_rows(n=300):
    """Documents that share a passage, which makes 0.742, with one true partner, at 0.758, for every third."""
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(171)]
    rows, i = [], 0
    for k in range(n):
        words = passage + [f"u{k}_{j}" for j in range(29)]
        rows.append((i, " ".join(words)))
        i += 1
        if k % 3 == 0:
            words[173:] = [f"v{k}_{j}" for j in range(27)]
            rows.append((i, " ".join(words)))
            i += 1
    rnd.shuffle(rows)
    return rows


def test_near_partners_behind_a_shared_passage(spark):
    rows = passage_rows(600)
    sets = {i: shingles(t) for i, t in rows}
    own = {i: next(w for w in t.split() if w.startswith("u")).split("_")[0] for i, t in rows}
    want = {}
    for i in sorted(own):
        want[i] = min(j for j in (i - 1, i) if own.get(j) == own[i])
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    assert all(linked(i, c) for i, c in want.items())
    assert not any(linked(i, j) for i in range(100) for j in range(i) if own[i] != own[j])
    got = {r["doc_id"]: r["component_id"] for r in N.group_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_prefix_join_alone_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(N, "candidates", lambda nodes, orders, reach, scratch: nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(N, "PAIR_BLOCK", 50)
    rows = near_rows() + [(5000 + i, t) for i, t in passage_rows(60)]
    want = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in N.group_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: c for i, (_, c) in want.items()}
