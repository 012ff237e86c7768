"""Block-wise signal processing against plain whole-track versions, whatever the blocks."""

import numpy as np
import pytest

from framewright.operators import audio


def tracks_of(spark, tracks, cut, seed=0):
    """Tracks dealt in blocks of about ``cut`` samples, in any order."""
    rng, rows = np.random.default_rng(seed), []
    for name, x in tracks.items():
        at = 0
        while at < len(x):
            n = int(rng.integers(1, 2 * cut)) if cut < 10**6 else len(x)
            rows.append((name, at, len(x), [float(v) for v in x[at : at + n]]))
            at += n
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "track string, start long, total long, samples array<float>").repartition(3)


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.track, r.start)):
        assert len(out.get(r.track, [])) == r.start
        out[r.track] = [*out.get(r.track, []), *r.samples]
        assert len(out[r.track]) <= r.total
    return {k: np.array(v) for k, v in out.items()}


def noise(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return {f"t{n}": rng.uniform(-1, 1, n).astype(np.float32) for n in lengths}


LENGTHS = [1, 2, 31, 200, 1777]


@pytest.mark.parametrize("cut, size, before, after", [(10**6, 64, 0, 0), (9, 64, 5, 11), (200, 16, 40, 33), (3, 7, 0, 20)])
def test_blocks_come_with_their_neighbours(spark, cut, size, before, after):
    tracks = noise(LENGTHS)
    got = {(r.track, r.k): r for r in audio.reblock(tracks_of(spark, tracks, cut), ["track"], size, before, after).collect()}
    assert got.keys() == {(t, k) for t, x in tracks.items() for k in range(-(-len(x) // size))}
    for (t, k), r in got.items():
        lo = max(0, k * size - before)
        assert r.first == lo and np.array_equal(np.array(r.samples, dtype=np.float32), tracks[t][lo : k * size + size + after])


def plain_resample(x, rate_in, rate_out):
    """Each output from the filter's definition."""
    cut = min(1.0, rate_out / rate_in)
    reach = int(np.ceil(audio.ZEROS / cut))
    out = []
    for j in range(-(-len(x) * rate_out // rate_in)):
        whole_, rest = divmod(j * rate_in, rate_out)
        d = np.arange(1 - reach, reach + 1) - rest / rate_out
        w = np.where(np.abs(d) <= reach, np.sinc(d * cut) * np.i0(audio.BETA * np.sqrt(np.clip(1 - (d / reach) ** 2, 0, None))), 0)
        i = whole_ + np.arange(1 - reach, reach + 1)
        ok = (i >= 0) & (i < len(x))
        out.append((w[ok] / w.sum() * x[i[ok]]).sum())
    return np.array(out)


@pytest.mark.parametrize("rate_in, rate_out", [(8000, 16000), (44100, 16000), (12000, 16000), (16000, 16000), (48000, 16000)])
def test_resampling_equals_whole_track_convolution(spark, rate_in, rate_out):
    tracks = noise(LENGTHS)
    for cut, block in ((10**6, 1 << 16), (40, 50), (7, 1)):
        got = whole(audio.resample(tracks_of(spark, tracks, cut), ["track"], rate_in, rate_out, block=block))
        for t, x in tracks.items():
            assert np.allclose(got[t], x if rate_in == rate_out else plain_resample(x.astype(np.float64), rate_in, rate_out), atol=1e-6)


def test_resampling_keeps_a_tone_and_drops_what_would_fold(spark):
    n = np.arange(9600)
    tones = {"low": np.sin(2 * np.pi * 1000 * n / 48000), "high": np.sin(2 * np.pi * 11000 * n / 48000)}
    got = whole(audio.resample(tracks_of(spark, tones, 1000), ["track"], 48000, 16000))
    want = np.sin(2 * np.pi * 1000 * np.arange(3200) / 16000)
    assert np.abs(got["low"] - want)[100:-100].max() < 1e-3 and np.abs(got["high"])[100:-100].max() < 1e-2


def test_quantised_as_sixteen_bits(spark):
    x = np.array([0.5 / 32768, 1.5 / 32768, -0.5 / 32768, 1.2, -1.2, 0.3], dtype=np.float32)
    got = whole(audio.quantize(tracks_of(spark, {"a": x}, 4)))["a"] * 32768
    assert got.tolist() == [0, 2, 0, 32767, -32768, round(float(x[5]) * 32768)]


def plain_gate(x, profile, n_fft, hop, deviations, reduction, n_bins, n_times):
    x = x.astype(np.float64)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)

    def frames(y):
        f = -(-(len(y) + n_fft - hop) // hop)
        padded = np.concatenate([np.zeros(n_fft - hop), y, np.zeros(2 * n_fft)])
        return np.array([np.fft.rfft(padded[i * hop : i * hop + n_fft] * w) for i in range(f)])

    db = lambda z: 20 * np.log10(np.abs(z) + 1e-10)
    quiet = db(frames(x[: max(1, min(profile, len(x)))]))
    z = frames(x)
    mask = (db(z) > quiet.mean(axis=0) + deviations * quiet.std(axis=0)).astype(float)
    smooth = np.zeros_like(mask)
    for i in range(mask.shape[0]):
        for j in range(mask.shape[1]):
            for a in range(-n_times, n_times + 1):
                for b in range(-n_bins, n_bins + 1):
                    if 0 <= i + a < mask.shape[0] and 0 <= j + b < mask.shape[1]:
                        smooth[i, j] += mask[i + a, j + b] * (n_times + 1 - abs(a)) / (n_times + 1) ** 2 * (n_bins + 1 - abs(b)) / (n_bins + 1) ** 2
    z *= 1 - reduction * (1 - smooth)
    out, weight = np.zeros(len(x) + 4 * n_fft), np.zeros(len(x) + 4 * n_fft)
    for i in range(len(z)):
        out[i * hop : i * hop + n_fft] += np.fft.irfft(z[i], n=n_fft) * w
        weight[i * hop : i * hop + n_fft] += w * w
    a = n_fft - hop
    return out[a : a + len(x)] / weight[a : a + len(x)]


@pytest.mark.parametrize("cut, block", [(10**6, 1 << 16), (30, 40), (11, 1)])
def test_gate_equals_a_plain_one(spark, cut, block):
    tracks = noise([1, 31, 90, 400])
    tracks["t400"][150:250] += 2 * np.sin(np.arange(100)).astype(np.float32)
    got = whole(audio.spectral_gate(tracks_of(spark, tracks, cut), ["track"], rate=1000, profile=64, n_fft=16, hop=4, deviations=0.5, reduction=0.9, smooth_hz=130, smooth_ms=9, block=block))
    for t, x in tracks.items():
        assert np.allclose(got[t], plain_gate(x, 64, 16, 4, 0.5, 0.9, 2, 2), atol=2e-6), t


def test_an_open_gate_changes_nothing(spark):
    tracks = noise([1, 500, 5000])
    blocks = tracks_of(spark, tracks, 300)
    for got in (whole(audio.spectral_gate(blocks, ["track"], reduction=0.0, block=700)), whole(audio.overlap_add(audio.stft(blocks, ["track"], 64, 16, block=100), ["track"], 64, 16, block=150))):
        for t, x in tracks.items():
            assert np.abs(got[t] - x).max() < 1e-6


def test_gate_lowers_noise_and_keeps_a_tone(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, 32000)
    x[16000:] += np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    got = whole(audio.spectral_gate(tracks_of(spark, {"a": x}, 5000), ["track"], deviations=4.0, smooth_hz=20))["a"]
    assert got[9000:15000].std() < 0.2 * x[9000:15000].std() and abs(got[20000:30000].std() - np.sqrt(0.5)) < 0.1


def test_frames_are_rows(spark):
    tracks = noise([5, 130])
    rows = audio.stft(tracks_of(spark, tracks, 20), ["track"], 32, 8, block=24).collect()
    assert {t: sorted(r.frame for r in rows if r.track == t) for t in tracks} == {t: list(range(audio.n_frames(len(x), 32, 8))) for t, x in tracks.items()}
    w = audio.hann(32)
    for r in rows:
        lo = (r.frame + 1) * 8 - 32
        x = np.array([tracks[r.track][i] if 0 <= i < r.total else 0 for i in range(lo, lo + 32)])
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), np.fft.rfft(x * w), atol=1e-6)


@pytest.mark.parametrize("cut, block", [(10**6, 1 << 16), (5000, 7680)])
def test_mel_patches_equal_a_plain_loop(spark, cut, block):
    tracks = noise([1, 15600, 15601, 40000])
    got = {(r.track, r.patch): np.array(r.mel) for r in audio.mel_patches(tracks_of(spark, tracks, cut), ["track"], block=block).collect()}
    edges = np.linspace(1127 * np.log(1 + 125 / 700), 1127 * np.log(1 + 7500 / 700), 66)
    weights = np.zeros((257, 64))
    for i in range(1, 257):
        m = 1127 * np.log(1 + i * 16000 / 512 / 700)
        for b in range(64):
            weights[i, b] = max(0, min((m - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - m) / (edges[b + 2] - edges[b + 1])))
    count = {"t1": 1, "t15600": 1, "t15601": 2, "t40000": 5}
    assert got.keys() == {(t, p) for t, n in count.items() for p in range(n)}
    for (t, p), mel in got.items():
        x = np.concatenate([tracks[t].astype(np.float64), np.zeros(20000)])
        for f in (0, 47, 95):
            frame = x[p * 7680 + f * 160 :][:400] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400))
            assert np.allclose(mel[f * 64 : f * 64 + 64], np.log(np.abs(np.fft.rfft(frame, n=512)) @ weights + 0.001), atol=1e-4)


def test_empty_tables(spark):
    none = tracks_of(spark, noise([5]), 9).limit(0)
    for out in (audio.resample(none, ["track"], 8000), audio.spectral_gate(none, ["track"]), audio.mel_patches(none, ["track"]), audio.stft(none, ["track"]), audio.quantize(none)):
        assert out.count() == 0


def test_frames_are_added_as_one_by_one():
    rng = np.random.default_rng(3)
    for n_fft, hop, lo, hi, number in [(16, 4, 300, 421, np.arange(70, 112)), (16, 4, 0, 30, np.arange(0, 11)), (16, 16, 5, 40, np.array([0, 2])), (16, 4, 10, 11, np.arange(0, 90))]:
        frames, want = rng.normal(size=(len(number), n_fft)), np.zeros(hi + 99 * n_fft)
        for f, x in zip(number, frames):
            want[(f + 1) * hop : (f + 1) * hop + n_fft] += x * audio.hann(n_fft)  # n_fft ahead
        assert (audio.added(frames, number, lo, hi, n_fft, hop) == want[n_fft + lo : n_fft + hi]).all()


def test_the_gate_keeps_samples_as_they_are_shuffled(spark):
    """Limits come as a column of their own, so samples aren't made doubles in the JVM."""
    blocks = spark.createDataFrame([(1, 0, 3, [0.1, 0.2, 0.3])], "t int, start long, total long, samples array<float>")
    plan = audio.spectral_gate(blocks, ["t"], rate=1000, profile=64, n_fft=16, hop=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan and "concat(" not in plan
