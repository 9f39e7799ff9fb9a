"""The corpus pipeline, stage by stage and as a whole, against brute force on a small table with odd rows."""

import hashlib
import random

import duckdb
import pytest
from test_dedup import brute_components, normal
from tokenizers import Tokenizer

import corpus_pipeline
from tallymark.llm import bpe, mixing, quality_rules
from tallymark.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, kept string, text_hash string, node int, kept_doc_id string"


def make_rows():
    rnd = random.Random(31)
    vocabulary = [f"word{i}" for i in range(2000)]
    fresh = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(60):
        words = fresh(rnd.randint(60, 150))
        texts.append(" ".join(words))
        for _ in range(rnd.choice([0, 0, 1, 4])):  # near copies
            near = list(words)
            near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            texts.append(" ".join(near))
        for _ in range(rnd.choice([0, 0, 1, 3])):  # exact copies
            texts.append(" ".join(words).upper())
    texts += [None, "", "too short", " ".join(["same"] * 200), " ".join(fresh(20_000)), " ".join(f"{w}###" for w in fresh(90))]
    rnd.shuffle(texts)
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), None, 1, "k", "h", 2, "x") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(make_rows(), SCHEMA).repartition(5).write.parquet(f"{where}/documents.parquet")
    return where


def kept_by_brute_force(sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, text, lang, source from read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    good = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.ORACLE_SQL}) where kept").fetchall()}
    texts = {r[0]: r[1] for r in make_rows()}
    largest = {}
    for i in sorted(good):
        largest[normal(texts[i])] = i
    single = sorted(largest.values())
    groups = brute_components([(i, texts[i]) for i in single])
    return good, set(single), {i for i, (_, root) in groups.items() if root == i}


def test_stages_keep_what_brute_force_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    wanted = kept_by_brute_force(sf_dir)
    assert len(wanted[0]) > len(wanted[1]) > len(wanted[2]) > 40
    rows = {r[0]: r for r in make_rows()}
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        docs = staged(stage(spark, docs, sf_dir), "test-" + name.replace(" ", "-"))
        assert docs.columns == columns, name
        got = docs.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(want), name
        assert all(tuple(r) == rows[r["doc_id"]] for r in got), name


def test_run_equals_its_parts(spark, sf_dir):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    texts = {r[0]: r[1] for r in make_rows()}
    want = kept_by_brute_force(sf_dir)[2]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id in ({', '.join(map(str, want))})")
    place = {r["doc_id"]: (r["slot"], r["order_key"]) for r in mixing.mix(kept).collect()}
    assert {r["doc_id"]: (r["slot"], r["order_key"]) for r in got} == place


def test_rows_that_share_an_id(spark):
    rnd = random.Random(5)
    text = lambda: " ".join(f"w{rnd.randrange(3000)}" for _ in range(80))
    one, two = text(), text()
    rows = [(7, one), (7, two), (7, "one word"), (7, one), (9, two), (None, text())]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = staged(stage(spark, docs, ""), "test-shared")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in docs.collect())
    assert got == sorted([(7, one), (9, two), (-1, rows[-1][1])])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_order_survives_several_files(spark):
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
