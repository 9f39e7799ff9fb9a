"""Quality classifier: ordinal cumulative-link regression on hashed text (operator 2).

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector shared by all grades and
ordered thresholds theta_1 < theta_2 < ... x has the document's distinct lower-cased words
without ASCII punctuation and their leading ``PREFIXES`` bytes, hashed to 2**BITS buckets,
counted and divided by the square root of the number of distinct words (so that the
chance words of a long text weigh no more than those of a short one), and a few coarse
shape marks. From the grade probabilities come the expected grade and the tail probability
P(grade >= target), by which documents are selected.

Training uses a bounded sample: about ``SAMPLE_DOCS`` rated documents for each grade,
chosen by a hash of doc_id outside the held-out fold (crc32(doc_id) mod 5 = 0). A bucket
carries weight if at least ``MIN_SHARE`` and at most ``MAX_SHARE`` of the sample's documents
have it, its documents are ``SCREEN`` standard errors or more off the grades' shares (fewer
for small samples, in which no bucket can be so far off, but ``LEAST_SCREEN``), and it is among the ``MOST`` that are furthest off. Workers count and cut the sample's texts;
the driver holds at most ``MOST`` numbers a document, whatever their length. The penalised
likelihood (``RIDGE``) is maximised by Fisher scoring, weights and thresholds jointly. The
model (2**BITS floats) is shipped to the workers, which score every whole text.

Defined cases: null text counts as empty text and has only the shape marks of an empty
text; ratings of unknown documents, null ratings and null doc_ids are not used; of
several ratings of a document the least counts; without ratings of two grades at least
the expected grade is the only grade known (0 without any) and the tail probability 1
or 0 accordingly; a tail probability of exactly one half is kept; texts of any length are
read whole; repeated rows are scored each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, staged, utf8

BITS = 18
SAMPLE_DOCS = 2_000
MIN_SHARE = 0.002
MAX_SHARE = 0.4
MAX_GRADES = 20
PREFIXES = (4, 5, 6, 7, 8)
SCREEN = 10.0
LEAST_SCREEN = 4.0
MOST = 1_000
RIDGE = 0.03
SCALE = 10.0
STEPS = 40
SAMPLE_TASKS = 8
SEED = 5


class Model(NamedTuple):
    grades: list[int]
    weights: np.ndarray
    theta: np.ndarray  # one per grade but the lowest, increasing


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << BITS) - 1)


def marks(text: bytes, n_words: int, n_distinct: int) -> list[bytes]:
    """Coarse shape of a text as words that no text can hold."""
    size = max(1, len(text) - n_words)
    share = lambda k: bytes([33 + min(9, 10 * k // size)])
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    lower = len(text) - len(text.translate(None, bytes(range(97, 123))))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>!"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    distinct = bytes([33 + 10 * n_distinct // (n_words + 1)])
    return [b" U" + share(upper), b" L" + share(lower), b" S" + share(symbols), b" D" + share(digits), b" R" + distinct, b" N" + bytes([33 + n_words.bit_length()])]


_MARKS = np.array([bucket(b" " + bytes([kind, 33 + k])) for kind in b"ULSDRN" for k in range(40)])


#: lower case, and blanks for ASCII punctuation, so that a word counts as the same word at the end of a clause
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def features(text: bytes) -> tuple[set[bytes], list[bytes]]:
    """Distinct words and shape marks."""
    words = text.translate(_PLAIN).split()
    distinct = set(words)
    return distinct, marks(text, len(words), len(distinct))


def scale(n_distinct: int) -> float:
    return SCALE / max(1, n_distinct) ** 0.5


def buckets_of(word: bytes) -> list[int]:
    """Buckets of a word and its prefixes."""
    return [bucket(word), *(bucket(b" P" + word[:k]) for k in PREFIXES if len(word) >= k)]


def _count_grades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each grade the documents, and those that have each bucket."""
    counts: dict[int, np.ndarray] = {}
    size: dict[int, int] = {}
    for batch in batches:
        for grade, text in zip(batch.column("grade").to_pylist(), batch.column("text").to_pylist()):
            have = counts.setdefault(grade, np.zeros(1 << BITS, np.int32))
            words, shape = features(text)
            have[list({b for w in words for b in buckets_of(w)} | {bucket(m) for m in shape})] += 1
            size[grade] = size.get(grade, 0) + 1
    packed = [zlib.compress(c.tobytes(), 1) for c in counts.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(size.values()), pa.int64()), pa.array(packed, pa.binary())], names=["grade", "n", "counts"])


def _columns_of(used: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's places and values among the buckets used."""
    place = {int(b): i for i, b in enumerate(used)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for text in batch.column("text").to_pylist():
                row = values_of(text, place)
                places.append(list(row))
                values.append(list(row.values()))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("doc_id"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["grade", "doc_id", "places", "x"])

    return run


def values_of(text: bytes, place: dict[int, int]) -> dict[int, float]:
    """The features of a text that have a place, by place."""
    words, shape = features(text)
    row: dict[int, float] = {}
    per_word = scale(len(words))
    for value, found in ((per_word, (b for w in words for b in buckets_of(w))), (1.0, map(bucket, shape))):
        for b in found:
            if (i := place.get(b)) is not None:
                row[i] = row.get(i, 0.0) + value
    return dict(sorted(row.items()))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def screen(by_grade: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many standard errors a bucket's documents are off the grades' shares, in the grade where they are most."""
    n, df = sizes.sum(), by_grade.sum(axis=0)
    share = (sizes / n)[:, None]
    spread = np.sqrt(np.maximum(df * (1 - df / n) * share * (1 - share), 1e-9))
    return (np.abs(by_grade - df * share) / spread).max(axis=0)


def choose(by_grade: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The buckets that carry weight: shape marks, and the furthest off of those that pass the screen."""
    n, df = sizes.sum(), by_grade.sum(axis=0)
    off = screen(by_grade, sizes)
    passed = np.flatnonzero((df >= max(2, MIN_SHARE * n)) & (df <= MAX_SHARE * n) & (off >= max(LEAST_SCREEN, min(SCREEN, 0.2 * n**0.5))))
    best = passed[np.argsort(-off[passed], kind="stable")[:MOST]]
    return np.union1d(best, _MARKS[df[_MARKS] > 0])


def likelihood(x: np.ndarray, ranks: np.ndarray, w: np.ndarray, theta: np.ndarray, hessian: bool = True) -> tuple:
    """Penalised log-likelihood, its gradient by (w, theta) and the expected information."""
    n, k, d = len(x), len(theta), len(w)
    value, grad, info = 0.0, np.zeros(d + k), np.zeros((d + k, d + k))
    for i in range(0, n, 1_000):  # blocks, so that temporaries stay small
        part, rank = x[i : i + 1_000].astype(np.float64), ranks[i : i + 1_000]
        m, at = len(part), np.arange(len(part))
        tail = np.concatenate([np.ones((m, 1)), _sigmoid((part @ w)[:, None] - theta), np.zeros((m, 1))], axis=1)
        slope = tail * (1 - tail)
        p = np.maximum(tail[:, :-1] - tail[:, 1:], 1e-12)
        # derivatives of each grade's probability by the score and by each threshold
        by_score = slope[:, :-1] - slope[:, 1:]
        by_theta = np.zeros((m, k + 1, k))
        for j in range(k):
            by_theta[:, j, j] = slope[:, j + 1]
            by_theta[:, j + 1, j] = -slope[:, j + 1]
        value += np.log(p[at, rank]).sum()
        grad[:d] += part.T @ (by_score[at, rank] / p[at, rank])
        grad[d:] += (by_theta[at, rank] / p[at, rank][:, None]).sum(axis=0)
        if hessian:
            info[:d, :d] += part.T @ (part * (by_score**2 / p).sum(axis=1)[:, None])
            info[:d, d:] += part.T @ ((by_score / p)[:, :, None] * by_theta).sum(axis=1)
            info[d:, d:] += np.einsum("mgj,mgl,mg->jl", by_theta, by_theta, 1 / p)
    info[d:, :d] = info[:d, d:].T
    info[np.arange(d), np.arange(d)] += RIDGE
    grad[:d] -= RIDGE * w
    return value - RIDGE / 2 * float(w @ w), grad, info


def train(x: np.ndarray, ranks: np.ndarray, grades: list[int], used: np.ndarray) -> Model:
    """Fit on rows of values of the buckets used, with grade ranks 0..K-1."""
    weights = np.zeros(1 << BITS, np.float32)
    k = len(grades) - 1
    if k < 1:
        return Model(grades, weights, np.zeros(0))
    tails = np.cumsum(np.bincount(ranks, minlength=k + 1)[::-1])[::-1][1:] / len(ranks)
    w, theta = np.zeros(x.shape[1]), np.log((1 - tails + 1e-9) / tails)
    value, grad, info = likelihood(x, ranks, w, theta)
    for _ in range(STEPS):
        step, pace = np.linalg.solve(info + 1e-8 * np.eye(len(info)), grad), 1.0
        while pace > 1e-6:
            w_, theta_ = w + pace * step[: len(w)], theta + pace * step[len(w) :]
            if (np.diff(theta_) > 1e-6).all() and likelihood(x, ranks, w_, theta_, hessian=False)[0] > value:
                break
            pace /= 2
        else:
            break
        before = value
        w, theta = w_, theta_
        value, grad, info = likelihood(x, ranks, w, theta)
        if value - before < 1e-7 * abs(before):
            break
    weights[used] = w
    return Model(grades, weights, theta)


def grade_tails(model: Model, scores: np.ndarray) -> np.ndarray:
    """P(grade >= k) for every known grade (documents, grades)."""
    if not len(model.theta):
        return np.ones((len(scores), max(1, len(model.grades))))
    return np.concatenate([np.ones((len(scores), 1)), _sigmoid(scores[:, None] - model.theta)], axis=1)


class _Weights(dict):
    """Weights of words, remembered up to a fixed number."""

    def __init__(self, model: Model):
        self.w = model.weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        v = self[word] = float(sum(self.w[b] for b in buckets_of(word)))
        return v


def _score(shared, target: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = _Weights(model)
        grades = np.array(model.grades or [0], float)
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                words, shape = features(text)
                scores.append(scale(len(words)) * sum(map(weights.__getitem__, words)) + sum(float(model.weights[bucket(m)]) for m in shape))
            tails = grade_tails(model, np.array(scores, float))
            probability = tails - np.concatenate([tails[:, 1:], np.zeros((len(tails), 1))], axis=1)
            expected = probability @ grades
            tail = probability @ (grades >= target)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(np.minimum(tail, 1.0))], names=["doc_id", "expected_grade", "tail_probability"])

    return run


def fit(docs: DataFrame, ratings: DataFrame) -> Model:
    """The model of ``ratings`` (doc_id, grade) over ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade")).where(crc_mod(F.col("doc_id"), 5) != 0)
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).orderBy("grade").limit(MAX_GRADES + 1).collect()}
    if len(counts) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} grades")
    if not counts:
        return Model([], np.zeros(1 << BITS, np.float32), np.zeros(0))
    rates = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) / 1_000_003
    chosen = rated.where(share < rates[F.col("grade")])  # bounded: about SAMPLE_DOCS for each of MAX_GRADES grades
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = staged(texts.select("grade", "doc_id", "text").repartition(SAMPLE_TASKS), "rated-sample")
    grades = sorted(counts)
    by_grade, sizes = np.zeros((len(grades), 1 << BITS), np.int64), np.zeros(len(grades), np.int64)
    for r in sample.mapInArrow(_count_grades, "grade int, n long, counts binary").collect():
        by_grade[grades.index(r["grade"])] += np.frombuffer(zlib.decompress(r["counts"]), np.int32)
        sizes[grades.index(r["grade"])] += r["n"]
    present = np.flatnonzero(sizes)  # a grade may have no rated document left
    grades, by_grade, sizes = [grades[i] for i in present], by_grade[present], sizes[present]
    if not grades:
        return Model([], np.zeros(1 << BITS, np.float32), np.zeros(0))
    used = choose(by_grade, sizes)
    rows = sample.mapInArrow(_columns_of(used), "grade int, doc_id long, places array<int>, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["grade"], r["places"]))
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["places"]] = r["x"]
    return train(x, np.array([grades.index(r["grade"]) for r in rows], np.int64), grades, used)


def score(docs: DataFrame, model: Model, target: int) -> DataFrame:
    """doc_id, expected_grade, tail_probability of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(_score(shared, target), "doc_id long, expected_grade double, tail_probability double")


def grades_of(labels: DataFrame) -> DataFrame:
    """The labels table as ratings: 0 poor, 1 good but toxic, 2 good and not toxic."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = score(docs, model, target=2)
    return found.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))).withColumn("kept", F.col("tail_probability") >= 0.5)
