"""Language identification with a bidirectional gated recurrent network over bytes (operator 9).

A text's UTF-8 bytes are cut into windows of ``WINDOW`` positions; two small gated
recurrent layers read each window forwards and backwards, a linear layer labels every
position, and a document's probabilities are the mean over all of its positions, each
counted once. Every whole text is read. Training is backpropagation through time in
numpy on the driver, on windows of a bounded sample: about ``SAMPLE_DOCS`` documents
for each language, but no more than about ``MOST_DOCS`` in all (at least ``LEAST_DOCS`` for
each language), chosen by a hash of doc_id, of which ``SAMPLE_WINDOWS`` windows each are
used. Every language of the fold is learned. No position sees beyond its window. The held-out fold (crc32(doc_id) mod 5 = 0)
is never used for training.

The gates use the piecewise linear sigmoid and the candidate x / (1 + |x|), which
cost a fraction of the exponential forms.

Defined cases: null text and text without a letter give ``und`` with score 0; without
any labelled training document everything is ``und``; a null doc_id is not held out
and not trained on; repeated rows are predicted each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod

WINDOW = 64
HIDDEN = 8
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
MOST_DOCS = 80_000
LEAST_DOCS = 8
EPOCHS = 6
BATCH = 128
SEED = 11
_RUN = 2048  # windows computed at once; their states fit in a core's cache
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Model(NamedTuple):
    langs: list[str]
    inputs: list[np.ndarray]  # for each direction: 3H x 256, input part of the gates
    states: list[np.ndarray]  # for each direction: 3H x H
    out: np.ndarray  # L x 2H
    bias: np.ndarray  # L


def _scan(table: np.ndarray, state: np.ndarray, data: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, B) of one direction over byte columns ``data`` (T, B)."""
    steps, width, size = data.shape[0], data.shape[1], state.shape[1]
    hidden = np.empty((steps, size, width), np.float32)
    h = np.zeros((size, width), np.float32)
    for t in range(steps):
        gates = np.take(table, data[t], axis=1)
        rec = state @ h
        rz = gates[: 2 * size] + rec[: 2 * size]
        rz *= 0.2
        rz += 0.5
        np.clip(rz, 0.0, 1.0, out=rz)
        r, z = rz[:size], rz[size:]
        pre = r * rec[2 * size :]
        pre += gates[2 * size :]
        cand = np.abs(pre)
        cand += 1.0
        np.divide(pre, cand, out=cand)
        if keep is not None:
            keep.append((h, r, z, cand, pre, rec[2 * size :]))
        new = h - cand
        new *= z
        new += cand
        hidden[t] = new
        h = hidden[t]
    return hidden


def position_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """Probabilities (T, L, B) of every position of byte windows (B, T)."""
    data = np.ascontiguousarray(windows.T)
    fore = _scan(model.inputs[0], model.states[0], data)
    back = _scan(model.inputs[1], model.states[1], data[::-1])[::-1]
    size = fore.shape[1]
    logits = np.matmul(model.out[:, :size], fore)
    logits += np.matmul(model.out[:, size:], back)
    logits += model.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _scan_gradient(table: np.ndarray, state: np.ndarray, data: np.ndarray, kept: list, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and state matrix from those of the hidden states (T, H, B)."""
    size = state.shape[1]
    d_table, d_state, carry = np.zeros_like(table), np.zeros_like(state), np.zeros_like(into[0])
    for t in range(len(kept) - 1, -1, -1):
        h, r, z, cand, pre, rec_n = kept[t]
        dh = into[t] + carry
        d_pre = dh * (1 - z) / (1 + np.abs(pre)) ** 2
        d_z = dh * (h - cand) * 0.2 * ((z > 0) & (z < 1))
        d_r = d_pre * rec_n * 0.2 * ((r > 0) & (r < 1))
        d_in = np.concatenate([d_r, d_z, d_pre])
        d_rec = np.concatenate([d_r, d_z, d_pre * r])
        np.add.at(d_table.T, data[t], d_in.T)
        d_state += d_rec @ h.T
        carry = dh * z + state.T @ d_rec
    return d_table, d_state


def loss_and_gradient(params: list[np.ndarray], windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions of the windows (B, T), and its gradient by each parameter."""
    inputs, states, out, bias = params[:2], params[2:4], params[4], params[5]
    size = out.shape[1] // 2
    data = np.ascontiguousarray(windows.T)
    kept: list[list] = [[], []]
    fore = _scan(inputs[0], states[0], data, kept[0])
    back = _scan(inputs[1], states[1], data[::-1], kept[1])[::-1]
    both = np.concatenate([fore, back], axis=1)
    logits = np.matmul(out, both) + bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(labels))
    loss = float(-np.log(np.maximum(p[:, labels, at], 1e-30)).mean())
    p[:, labels, at] -= 1
    p /= p.shape[0] * p.shape[2]
    d_both = np.matmul(out.T, p)
    tables, mats = zip(
        _scan_gradient(inputs[0], states[0], data, kept[0], d_both[:, :size]),
        _scan_gradient(inputs[1], states[1], data[::-1], kept[1], d_both[::-1, size:]),
    )
    return loss, [*tables, *mats, np.einsum("tlb,thb->lh", p, both), p.sum(axis=(0, 2))]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> Model:
    """Fit by Adam on the mean cross-entropy of all positions of the windows (N, T)."""
    rng = np.random.default_rng(SEED)
    n_langs = len(langs)
    inputs = [rng.normal(0, 0.5, (3 * HIDDEN, 256)).astype(np.float32) for _ in range(2)]
    states = [rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32) for _ in range(2)]
    out, bias = rng.normal(0, 0.3, (n_langs, 2 * HIDDEN)).astype(np.float32), np.zeros(n_langs, np.float32)
    params = [*inputs, *states, out, bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = max(1, epochs * -(-len(windows) // BATCH))
    for _ in range(epochs if n_langs > 1 else 0):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            _, grads = loss_and_gradient(params, windows[rows], labels[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                params[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(langs, inputs, states, out, bias)


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, T) over all bytes and, for each, how many leading positions not to count.

    The last window ends with the text and may overlap the one before; a text shorter
    than a window is padded with spaces in front, which are not counted.
    """
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if n < WINDOW:
        return np.concatenate([np.full(WINDOW - n, 32, np.uint8), raw])[None], np.array([WINDOW - n])
    whole = n // WINDOW
    windows, skip = raw[: whole * WINDOW].reshape(whole, WINDOW), np.zeros(whole, np.int64)
    if rest := n - whole * WINDOW:
        windows, skip = np.concatenate([windows, raw[None, n - WINDOW :]]), np.append(skip, WINDOW - rest)
    return windows, skip


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities (documents, L); texts are not empty."""
    pieces = [cut(t) for t in texts]
    windows, skip = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    owner = np.repeat(np.arange(len(texts)), [len(p[0]) for p in pieces])
    sums = np.zeros((len(texts), len(model.langs)))
    place = np.arange(WINDOW)[:, None]
    for i in range(0, len(windows), _RUN):
        p = position_probabilities(model, windows[i : i + _RUN])
        part = skip[i : i + _RUN]
        if part.any():
            p *= (place >= part)[:, None, :]
        per_window = p.sum(axis=0).T
        for k in range(sums.shape[1]):
            sums[:, k] += np.bincount(owner[i : i + _RUN], per_window[:, k], len(texts))
    return sums / np.array([len(t) for t in texts])[:, None]


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and model.langs and has_letter(t)]
            if known:
                p = document_probabilities(model, [texts[i] for i in known])
                for i, k, row in zip(known, p.argmax(axis=1), p):
                    langs[i], scores[i] = model.langs[k], float(min(row[k], 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def sample_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of the training sample."""
    fold = docs.where("lang is not null and length(text) > 0").where(crc_mod(F.col("doc_id"), 5) != 0)
    counts = fold.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    if not langs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    each = max(LEAST_DOCS, min(SAMPLE_DOCS, MOST_DOCS // len(langs)))
    rates = counts.select("lang", (F.lit(float(each)) / F.col("n")).alias("rate"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED)), F.lit(1_000_003)) / 1_000_003
    chosen = fold.join(F.broadcast(rates), "lang").where(share < F.col("rate"))  # one row a language
    at = lambda k: F.substring("text", F.lit(1) + F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(100 + k)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int"), F.lit(WINDOW))
    rows = chosen.select("doc_id", "lang", *[at(k).alias(f"w{k}") for k in range(SAMPLE_WINDOWS)]).collect()
    windows, labels, number = [], [], {lang: i for i, lang in enumerate(langs)}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["w0"])):
        for k in range(SAMPLE_WINDOWS):
            windows.append(cut(r[f"w{k}"].encode())[0][0])
            labels.append(number[r["lang"]])
    return np.array(windows, np.uint8).reshape(-1, WINDOW), np.array(labels, np.int64), langs


def fit(docs: DataFrame) -> Model:
    return train(*sample_windows(docs))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    model = model or fit(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
