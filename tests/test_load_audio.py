"""Files of several rates to clean mono audio and speech chunks."""

import numpy as np
import pytest
from test_audio import plain_resample

from framewright.plans.modalities import AudioConfig, clean_audio, load_audio, speech_chunks
from framewright.sources.wave import wave_bytes


@pytest.fixture
def files(spark, tmp_path):
    rng = np.random.default_rng(0)
    tracks = {"a": (16000, 900), "b": (8000, 450), "c": (44100, 1300), "d": (16000, 1), "e": (8000, 0)}
    data = {k: rng.integers(-20000, 20000, n) / 32768 for k, (_, n) in tracks.items()}
    for k, (rate, _) in tracks.items():
        (tmp_path / f"{k}.wav").write_bytes(wave_bytes(data[k], rate))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    rows = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    return rows, {k: plain_resample(x, tracks[k][0], 16000) if tracks[k][0] != 16000 else x for k, x in data.items() if len(x)}


def name(path):
    return path.rsplit("/", 1)[1].removesuffix(".wav")


def test_rates_meet(files):
    rows, want = files
    got = {name(r.path): r for r in load_audio(rows).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.start == 0 and r.total == len(want[k]) and np.abs(np.array(r.samples) - want[k]).max() <= 0.5 / 32768 + 1e-6
        assert all(float(x * 32768).is_integer() for x in r.samples)
    assert {name(r.path) for r in clean_audio(rows).collect()} == want.keys()
    assert load_audio(rows.limit(0)).count() == 0


@pytest.mark.parametrize("overlap", [0.0, 0.005, 0.0187])
def test_chunks_follow_the_plan(files, overlap):
    rows, want = files
    config = AudioConfig(chunk_sec=0.02, overlap_sec=overlap, min_chunk=40)
    chunk, hop = 320, max(1, 320 - int(overlap * 16000))
    got = {(name(r.path), r.chunk_id): r for r in speech_chunks(load_audio(rows), config).collect()}
    plan = {}
    for k, x in want.items():
        start = i = 0
        while start < len(x):
            end = min(len(x), start + chunk)
            if end - start >= 40:
                plan[k, i] = (start, end - start)
            if end == len(x):
                break
            start, i = start + hop, i + 1
    assert {k: (r.start, len(r.samples)) for k, r in got.items()} == plan
