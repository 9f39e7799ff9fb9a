"""Recordings: decoding, chunks and levels against plain Python."""

import io
import struct
import wave

import numpy as np
import pytest

from tallymark.sources import audio


def wav(frames, rate=8000, width=2):
    """A file of frames (lists of one integer a channel)."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(frames[0]) if frames else 1)
        w.setsampwidth(width)
        w.setframerate(rate)
        pack = {1: lambda v: struct.pack("B", v + 128), 2: lambda v: struct.pack("<h", v), 3: lambda v: struct.pack("<i", v << 8)[1:], 4: lambda v: struct.pack("<i", v)}[width]
        w.writeframes(b"".join(pack(v) for f in frames for v in f))
    return out.getvalue()


@pytest.mark.parametrize(("width", "most"), [(1, 127), (2, 2**15 - 1), (3, 2**23 - 1), (4, 2**31 - 1)])
def test_pcm_of_any_width(width, most):
    frames = [[0, -1], [most, -most - 1], [-most // 3, 5]]
    rate, got = audio.decode_wav(wav(frames, 11_025, width))
    assert rate == 11_025 and np.allclose(got * (most + 1), frames, atol=1e-6)


def test_other_rates():
    x = np.arange(10, dtype=float)[:, None]
    assert audio.mono(x, 8000, 8000).tolist() == list(range(10))
    assert audio.mono(x, 8000, 16_000)[:5].tolist() == [0, 0.5, 1, 1.5, 2] and len(audio.mono(x, 8000, 16_000)) == 20
    assert audio.mono(x, 16_000, 8000).tolist() == [0, 2, 4, 6, 8]
    assert audio.mono(np.zeros((0, 1)), 8000, 16_000).tolist() == []
    assert audio.mono(np.array([[1.0, 0.0]]), 1, 1).tolist() == [0.5]


def test_chunks_and_levels(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {"a": rng.integers(-9000, 9000, 2500), "b/c": rng.integers(-50, 50, 1000), "empty": np.zeros(0, int)}
    for name, samples in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.wav").write_bytes(wav([[int(v)] for v in samples], 1000))
    (tmp_path / "broken.wav").write_bytes(b"RIFF no")
    (tmp_path / "other.mp3").write_bytes(b"x")
    files = audio.recordings(spark, [str(tmp_path)])
    got = {}
    for r in audio.chunks(files, 0.9, 1000).collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["chunk"], r["offset_s"], None if r["samples"] is None else [round(v * 32768) for v in r["samples"]], r["error"]))
    assert sorted((k, o, len(s)) for k, o, s, _ in got["a.wav"]) == [(0, 0.0, 900), (1, 0.9, 900), (2, 1.8, 700)]
    assert [v for _, _, s, _ in sorted(got["a.wav"]) for v in s] == made["a"].tolist()
    assert got["broken.wav"][0][:3] == (None, None, None) and "Error" in got["broken.wav"][0][3] and set(got) == {"a.wav", "c.wav", "broken.wav"}
    levels = {}
    for r in audio.levels(files, 1000, 32).where("error is null").collect():
        levels.setdefault(r["path"].rsplit("/", 1)[-1], {})[r["frame"]] = r["db"]
    x = made["a"] / 32768
    assert len(levels["a.wav"]) == 2500 // 32 and len(levels["c.wav"]) == 1000 // 32
    for k, db in levels["a.wav"].items():
        assert abs(db - 20 * np.log10(np.sqrt(np.mean(x[k * 32 : k * 32 + 32] ** 2) + 1e-12) + 1e-12)) < 1e-9


def test_a_decoder_of_ones_own(spark, tmp_path):
    (tmp_path / "x.raw").write_bytes(bytes([1, 2, 3]))
    files = audio.recordings(spark, [str(tmp_path)], "*.raw")
    got = audio.chunks(files, 1.0, 2, decode=lambda data: (2, np.frombuffer(data, np.uint8)[:, None] / 4.0)).orderBy("chunk").collect()
    assert [list(r["samples"]) for r in got] == [[0.25, 0.5], [0.75]]
