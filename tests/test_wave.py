"""WAVE files against a plain reader, whole and damaged, by byte ranges and from contents."""

import io
import struct
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.sources import wave as wv
from framewright.sources.ranged import reader


def built(kind, x, rate=8000, before=b"", size=None, tag=None, rf64=False):
    """A file of samples ``x`` (by time and channel, in -1 to 1), of kind u8, i16, i24, i32, f32 or f64; extensible if ``tag`` is given."""
    bits, channels = int(kind[1:]), x.shape[1]
    if kind[0] == "f":
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif kind == "u8":
        data = (x * 127 + 128).astype(np.uint8).tobytes()
    else:
        whole = (x * (2 ** (bits - 1) - 1)).astype("<i4")
        data = whole.astype(f"<i{bits // 8}").tobytes() if bits != 24 else b"".join(struct.pack("<i", v)[:3] for v in whole.reshape(-1).tolist())
    plain = 3 if kind[0] == "f" else 1
    fmt = struct.pack("<HHIIHH", tag or plain, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if tag == wv.EXTENSIBLE:
        fmt += struct.pack("<HHIH", 22, bits, 0, plain) + b"\0" * 14
    out = b"fmt " + struct.pack("<I", len(fmt)) + fmt + before + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    if rf64:
        out = b"ds64" + struct.pack("<IQQ", 28, 0, len(data)) + b"\0" * 12 + out
    return (b"RF64" if rf64 else b"RIFF") + struct.pack("<I", 4 + len(out)) + b"WAVE" + out, data


def plain(kind, data, channels):
    """Sample by sample."""
    bits = int(kind[1:])
    n = bits // 8
    out = []
    for i in range(0, len(data), n):
        b = data[i : i + n]
        if kind[0] == "f":
            out.append(struct.unpack("<f" if n == 4 else "<d", b)[0])
        elif kind == "u8":
            out.append((b[0] - 128) / 128)
        else:
            out.append(int.from_bytes(b, "little", signed=True) / 2 ** (bits - 1))
    x = np.array(out).reshape(-1, channels)
    return x.mean(axis=1)


KINDS = ["u8", "i16", "i24", "i32", "f32", "f64"]
LIST = b"LIST" + struct.pack("<I", 5) + b"INFOx" + b"\0"  # an odd chunk and its pad


def files_of(spark, folder):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(folder))


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.block)):
        name = r.path.rsplit("/", 1)[1]
        assert len(out.get(name, [])) == r.start
        out[name] = [*out.get(name, []), *r.samples]
        assert r.total >= len(out[name])
    return out


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_formats_equal_a_plain_reader(spark, tmp_path, block):
    rng = np.random.default_rng(1)
    want = {}
    for kind in KINDS:
        for channels in (1, 2, 3):
            for tag, rf64, before in ((None, False, b""), (wv.EXTENSIBLE, False, LIST), (None, True, LIST)):
                name = f"{kind}-{channels}-{tag}-{rf64}.wav"
                content, data = built(kind, rng.uniform(-1, 1, (rng.integers(1, 60), channels)), before=before, tag=tag, rf64=rf64, size=wv.OPEN_END if rf64 else None)
                (tmp_path / name).write_bytes(content)
                want[name] = plain(kind, data, channels)
    (tmp_path / "empty.wav").write_bytes(built("i16", np.zeros((0, 1)))[0])
    files = files_of(spark, tmp_path)
    headers = wv.wave_headers(files)
    assert headers.count() == len(want) + 1 and headers.where("status = 'ok' AND rate = 8000").count() == len(want) + 1
    for rows in (wv.wave_blocks(headers, block).collect(), wv.wave_blocks_of(files, block).collect()):
        got = joined(rows)
        assert got.keys() == want.keys()
        for name, x in want.items():
            assert np.allclose(got[name], x, atol=1e-6), name


def test_standard_library_agrees(spark, tmp_path):
    x = np.random.default_rng(2).uniform(-1, 1, 1000)
    (tmp_path / "a.wav").write_bytes(wv.wave_bytes(x, 16000))
    with wave.open(str(tmp_path / "a.wav")) as f:
        assert (f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()) == (16000, 1, 2, 1000)
        ints = np.frombuffer(f.readframes(1000), dtype="<i2")
    got = joined(wv.wave_blocks(wv.wave_headers(files_of(spark, tmp_path)), 64).collect())["a.wav"]
    assert np.array_equal(np.array(got, dtype=np.float32), (ints / 32768).astype(np.float32))


def test_damaged_files_say_so(spark, tmp_path):
    good, _ = built("i16", np.zeros((100, 1)))
    bad = {
        "text": b"not a wave file at all", "cut-header": good[:20], "no-data": good[:36], "truncated": good[:-50], "data-first": b"RIFF\0\0\0\0WAVEdata" + struct.pack("<I", 4) + b"\0" * 4,
        "mulaw": built("i16", np.zeros((10, 1)), tag=7)[0], "no-channels": built("i16", np.zeros((0, 0)))[0], "huge-chunk": good[:36] + b"junk" + struct.pack("<I", 2**32 - 2) + good[36:], "cut-extensible": good[:20] + struct.pack("<H", wv.EXTENSIBLE) + good[22:],
    }
    for name, content in bad.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    files = files_of(spark, tmp_path)
    for rows in (wv.wave_headers(files).collect(), wv.wave_blocks_of(files).collect()):
        assert len(rows) == len(bad) and all(r.status == "error" and "Damaged" in r.error and r.total is None for r in rows)
    assert wv.wave_blocks(wv.wave_headers(files)).count() == 0
    kept = wv.wave_headers(files, keep_truncated=True).where("status = 'ok'").collect()
    assert [(r.path.rsplit("/", 1)[1], r.total) for r in kept] == [("truncated.wav", 75)]
    gone = spark.createDataFrame([(str(tmp_path / "gone.wav"), 44)], "path string, length long")
    assert "FileNotFoundError" in wv.wave_headers(gone).first().error


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=120), st.booleans())
def test_any_bytes_parse_or_say_damaged(tail, keep):
    for data in (tail, b"RIFF\0\0\0\0WAVE" + tail, b"RIFF\0\0\0\0WAVEfmt " + tail):
        try:
            w = wv.parse_wave(reader(io.BytesIO(data), len(data)), len(data), keep)
        except wv.Damaged:
            continue
        assert w.data_start + w.total * w.stride <= len(data)


def test_only_headers_and_ranges_are_read():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    content, _ = built("i16", np.zeros((2_000_000, 1)), before=b"junk" + struct.pack("<I", 1_000_000) + b"\0" * 1_000_000)
    f = Counting(content)
    assert wv.parse_wave(reader(f, len(content)), len(content)).total == 2_000_000
    assert Counting.taken <= 3 << 16


def test_files_written_by_tasks(spark, tmp_path):
    rows = [(i, [((i * 7919 + k * 104729) % 65536 - 32768) / 32768 for k in range(i)]) for i in range(12)] + [(99, [2.0, -2.0, 0.5 / 32768, 1.5 / 32768])]
    tracks = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    written = wv.write_waves(tracks, f"file://{tmp_path}/out", "id", "x", 8000)
    got = joined(wv.wave_blocks(wv.wave_headers(written), 5).collect())
    assert {n: list(x) for n, x in got.items()} == {f"{i}.wav": x for i, x in rows if i and i != 99} | {"99.wav": [32767 / 32768, -1.0, 0.0, 2 / 32768]}
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".")] == []
    assert files_of(spark, tmp_path / "out").agg(F.count("*")).first()[0] == len(rows)
