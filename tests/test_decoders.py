"""Real containers through the modality plans; only the models are stubs."""

import numpy as np
from stub_backend import StubBackend
from test_audio import plain_gate, plain_resample

from framewright.plans.modalities import audio_embeddings, video_embeddings
from framewright.sources.decoders import ContainerDecoder
from framewright.sources.mp4 import mp4_bytes
from framewright.sources.wave import wave_bytes


class Decoding(ContainerDecoder, StubBackend):
    """The stub's models over real files."""

    def __init__(self):
        StubBackend.__init__(self)

    def open(self):
        ContainerDecoder.open(self)
        StubBackend.open(self)

    def encode_frames(self, frames):
        assert len(frames) == 16 and all(f.shape == (3, 5, 3) for f in frames)
        return np.array([[float(f[0, 0, k]) for k in range(3)] + [float(np.mean([x[0, 0, 0] for x in frames]))] for f in frames])


def test_audio_of_wave_files(spark, tmp_path):
    x = np.random.default_rng(0).integers(-9000, 9000, 6000) / 32768
    (tmp_path / "a.wav").write_bytes(wave_bytes(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    d = Decoding()
    d.open()
    got = d.decode_audio(str(tmp_path / "a.wav"))
    assert len(got) == 12000 and np.abs(got - plain_resample(x, 8000, 16000)).max() <= 0.5 / 32768 + 1e-6
    media = spark.createDataFrame([(k, str(tmp_path / f"{k}.wav")) for k in "ab"], "video_id string, path string")
    rows = {(r.video_id, r.modality): r for r in audio_embeddings(media, Decoding())[0].collect()}
    assert len(rows) == 6 and all((r.status == "ok") == (k == "a") for (k, _), r in rows.items()) and rows["a", "background"].vec == [3.0] * 4


def test_denoising_is_the_gate():
    x = np.random.default_rng(1).normal(size=3000)
    from framewright.operators.audio import gate_array

    got = gate_array(x, x[:64], 1000, 16, 4, 0.5, 0.9, 130, 9)
    assert np.allclose(got, plain_gate(x, 64, 16, 4, 0.5, 0.9, 2, 2), atol=1e-6) and len(gate_array(x[:0], x[:1])) == 0


def test_video_of_mp4_files(spark, tmp_path):
    frames = [np.random.default_rng(i).integers(0, 256, (3, 5, 3), dtype=np.uint8) for i in range(60)]
    cut = [f.tobytes() for f in frames]
    cut[0] = cut[0][:-1]  # the first planned frame can't be decoded
    (tmp_path / "rgb.mp4").write_bytes(mp4_bytes(cut, [i % 9 == 0 for i in range(60)], width=5, height=3))
    (tmp_path / "bgr.mp4").write_bytes(mp4_bytes([f[:, :, ::-1].tobytes() for f in frames], [True] * 60, codec=b"BGR ", width=5, height=3))
    (tmp_path / "none.mp4").write_bytes(mp4_bytes([], []))
    (tmp_path / "coded.mp4").write_bytes(mp4_bytes(cut, [True] * 60, codec=b"avc1", width=5, height=3))
    d = Decoding()
    d.open()
    assert np.array_equal(d.read_frame(str(tmp_path / "bgr.mp4"), 37), frames[37]) and d.read_frame(str(tmp_path / "rgb.mp4"), 0) is None and d.read_frame(str(tmp_path / "rgb.mp4"), 60) is None
    idx = [int(round(v)) for v in np.linspace(0, 59, 16)]
    media = spark.createDataFrame([(k, str(tmp_path / f"{k}.mp4")) for k in ("rgb", "bgr", "none", "coded", "gone")], "video_id string, path string")
    got = {r.video_id: r for r in video_embeddings(media, Decoding()).collect()}
    assert {k: r.status for k, r in got.items()} == {"rgb": "ok", "bgr": "ok", "none": "error", "coded": "error", "gone": "error"} and "frame count" in got["none"].error and "No frames decoded" in got["coded"].error
    for k, planned in (("bgr", idx), ("rgb", [*idx[1:], idx[-1]])):
        first = np.array([*frames[planned[0]][0, 0].astype(float), np.mean([float(frames[i][0, 0, 0]) for i in planned])])
        assert np.allclose(got[k].vec, first / np.linalg.norm(first), atol=1e-6)
