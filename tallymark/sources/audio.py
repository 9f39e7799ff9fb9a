"""Recordings: decoding, chunks and levels (IO19, SC38).

Uncompressed WAV is decoded here. Other formats need a decoder of their own, which every
function takes as ``decode``: bytes to (rate, samples in [-1, 1], one row a frame and one column
a channel). A file is one row and is decoded in one task; what leaves it is rows of bounded size.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RATE = 16_000
CHUNK_SECONDS = 28.0
FRAME_MS = 32

Decoder = Callable[[bytes], tuple[int, np.ndarray]]


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames x channels, in [-1, 1]) of a PCM file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 1:  # the only unsigned one
        samples = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        low = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = (((low[:, 2] << 24) | (low[:, 1] << 16) | (low[:, 0] << 8)) >> 8) / 2.0**23
    else:
        samples = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return rate, samples.reshape(-1, channels)


def mono(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """The mean of the channels at another rate, by linear interpolation; at the same rate nothing is interpolated."""
    one = samples.mean(axis=1) if samples.size else np.zeros(0)
    if rate == wanted or not len(one):
        return one
    return np.interp(np.arange(round(len(one) * wanted / rate)) * (rate / wanted), np.arange(len(one)), one)


def recordings(spark: SparkSession, folders: list[str], glob: str = "*.wav") -> DataFrame:
    """path and content of the files below the folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folders).select("path", "content")


def _each(files: DataFrame, schema: str, rate: int, decode: Decoder, rows: Callable[[np.ndarray], Iterator[pd.DataFrame]]) -> DataFrame:
    """``rows`` of every file's samples, under its path; a file that cannot be decoded is one row with its error."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))  # few recordings at once

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    had, samples = decode(bytes(content))
                except Exception as e:  # whatever a decoder raises
                    yield pd.DataFrame({n: [None] for n in names} | {"path": [path], "error": [f"{type(e).__name__}: {e}"]}, dtype=object)
                    continue
                for found in rows(mono(samples, had, rate)):
                    yield found.assign(path=path, error=None)[names]

    names = [c.split()[0] for c in schema.split(", ")]
    return files.mapInPandas(run, schema)


def chunks(files: DataFrame, seconds: float = CHUNK_SECONDS, rate: int = RATE, decode: Decoder = decode_wav) -> DataFrame:
    """path, chunk, offset_s, samples and error: the recordings (path, content) cut into windows, the last one shorter."""
    step = int(rate * int(seconds * 1000) / 1000)

    def rows(samples: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(samples), step):
            yield pd.DataFrame({"chunk": pd.array([i // step], "Int32"), "offset_s": [i / rate], "samples": [samples[i : i + step].astype(np.float32)]})

    return _each(files, "path string, chunk int, offset_s double, samples array<float>, error string", rate, decode, rows)


def levels(files: DataFrame, rate: int = RATE, frame_ms: int = FRAME_MS, decode: Decoder = decode_wav) -> DataFrame:
    """path, frame, db and error: the level of every whole frame of the recordings (path, content)."""
    size, most = int(rate * frame_ms / 1000), 100_000

    def rows(samples: np.ndarray) -> Iterator[pd.DataFrame]:
        for first in range(0, len(samples) // size, most):
            part = samples[first * size : (first + most) * size]
            frames = part[: len(part) // size * size].reshape(-1, size)
            rms = np.sqrt((frames * frames).mean(axis=1) + 1e-12)
            yield pd.DataFrame({"frame": pd.array(np.arange(first, first + len(frames)), "Int64"), "db": 20 * np.log10(rms + 1e-12)})

    return _each(files, "path string, frame long, db double, error string", rate, decode, rows)
