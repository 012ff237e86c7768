"""Planned frames of MP4 files: byte ranges against a full scan, order of presentation, damage."""

import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.sources import mp4
from framewright.sources.ranged import reader


def parsed(data):
    return mp4.parse_mp4(reader(io.BytesIO(data), len(data)), len(data))


def packets(n, seed=0, most=40):
    rng = np.random.default_rng(seed)
    return [rng.bytes(int(rng.integers(1, most))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9, 50])
@pytest.mark.parametrize("tail", [True, False])
def test_sample_tables(n, tail):
    frames, keys = packets(n), [i % 7 == 0 for i in range(n)]
    data = mp4.mp4_bytes(frames, keys, tail=tail)
    (t,) = parsed(data)
    assert (t.kind, t.codec, t.timescale) == ("vide", "raw ", 1000)
    assert [data[a : a + s] for a, s in zip(t.offsets, t.sizes)] == frames
    assert t.pts.tolist() == [40 * i for i in range(n)] and t.keys.tolist() == [i // 7 * 7 for i in range(n)] and t.decode.tolist() == list(range(n))


def test_order_of_presentation():
    order = [0, 3, 1, 2, 6, 4, 5]  # decoded 0, 1, 2, ..; shown at these places
    (t,) = parsed(mp4.mp4_bytes(packets(7), [True] + [False] * 6, order=order))
    assert t.decode.tolist() == [order.index(i) for i in range(7)] and t.pts.tolist() == [40 * i for i in order]


def write(folder, name, data):
    (folder / f"{name}.mp4").write_bytes(data)


def files_of(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).select("path", "length")


def test_planned_packets_equal_a_full_scan(spark, tmp_path):
    videos = {f"v{n}": packets(n, n) for n in (1, 2, 15, 16, 17, 60, 333)}
    for name, frames in videos.items():
        order = list(range(len(frames)))
        if name == "v60":
            for i in range(1, 58, 3):
                order[i : i + 3] = [i + 2, i, i + 1]
        write(tmp_path, name, mp4.mp4_bytes(frames, [i % 10 == 0 for i in range(len(frames))], order=order, tail=name != "v17"))
    write(tmp_path, "none", mp4.mp4_bytes([], []))
    index = mp4.mp4_index(files_of(spark, tmp_path))
    assert index.where("status = 'ok'").count() == len(videos) + 1
    for gap in (0, 1 << 16):
        got = {}
        for r in mp4.read_packets(mp4.planned_packets(index), gap).collect():
            got.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".mp4"), {})[r.slot] = r
        assert got.keys() == videos.keys()
        for name, slots in got.items():
            frames, n = videos[name], len(videos[name])
            want = list(range(n)) + [n - 1] * (16 - n) if n <= 16 else [int(round(x)) for x in np.linspace(0, n - 1, 16)]
            assert [slots[s].frame_idx for s in range(16)] == want
            for r in slots.values():
                decode = r.frame_idx
                if name == "v60" and 1 <= decode < 58:
                    decode = (decode - 1) // 3 * 3 + 1 + [1, 2, 0][(decode - 1) % 3]
                assert r.packets == frames[decode // 10 * 10 : decode + 1] and r.pts == 40 * r.frame_idx


def test_only_needed_ranges_are_read():
    taken = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            taken.append(len(out))
            return out

    frames = [bytes(10_000)] * 2000
    data = mp4.mp4_bytes(frames, [i % 50 == 0 for i in range(2000)])
    f = Counting(data)
    (t,) = mp4.parse_mp4(reader(f, len(data)), len(data))
    assert len(t.sizes) == 2000 and sum(taken) < 400_000 < len(data) / 40
    assert mp4.spans(t.offsets[[5, 6, 900]], t.sizes[[5, 6, 900]]) == [(t.offsets[5], t.offsets[6] + 10_000), (t.offsets[900], t.offsets[900] + 10_000)]


def test_frames_without_a_keyframe_stand_alone(spark, tmp_path):
    write(tmp_path, "a", mp4.mp4_bytes(packets(4), [False, False, True, False]))
    rows = sorted(mp4.planned_packets(mp4.mp4_index(files_of(spark, tmp_path)), 4).collect(), key=lambda r: r.slot)
    assert [len(r.sizes) for r in rows] == [1, 1, 1, 2]


def test_damaged_files_say_so(spark, tmp_path):
    good = mp4.mp4_bytes(packets(30), [True] * 30)
    at = good.index(b"stsz")
    bad = {
        "text": b"not a video at all", "no-moov": good[: good.index(b"moov") - 4], "cut": good[:-20], "zeros": bytes(100),
        "too-many": good[: at + 12] + struct.pack(">I", 2**31) + good[at + 16 :], "beyond": good.replace(good[good.index(b"co64") + 12 :][:8], struct.pack(">Q", 2**40), 1), "huge-box": struct.pack(">I4s", 2**31, b"ftyp") + good[8:],
    }
    for name, data in bad.items():
        write(tmp_path, name, data)
    rows = mp4.mp4_index(files_of(spark, tmp_path)).collect()
    assert len(rows) == len(bad) and all(r.status == "error" and "Damaged" in r.error for r in rows), [(r.path, r.error) for r in rows]
    assert mp4.planned_packets(mp4.mp4_index(files_of(spark, tmp_path))).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.booleans())
def test_any_damage_is_told_or_harmless(seed, changes, tail):
    rng = np.random.default_rng(seed)
    data = bytearray(mp4.mp4_bytes(packets(9), [i % 3 == 0 for i in range(9)], order=[0, 2, 1, 3, 5, 4, 6, 8, 7], tail=tail))
    for _ in range(changes):
        data[rng.integers(len(data))] = rng.integers(256)
    try:
        for t in parsed(bytes(data)):
            assert all(0 <= a <= a + n <= len(data) for a, n in zip(t.offsets, t.sizes))
    except mp4.Damaged:
        pass


def test_audio_tracks_are_listed_but_not_planned(spark, tmp_path):
    write(tmp_path, "a", mp4.mp4_bytes(packets(5), [True] * 5).replace(b"vide", b"soun"))
    index = mp4.mp4_index(files_of(spark, tmp_path))
    assert index.select("kind", "n_frames").collect() == [("soun", 5)] and mp4.planned_packets(index).count() == 0
    assert mp4.read_packets(mp4.planned_packets(index)).count() == 0 and index.where(F.col("path").isNull()).count() == 0
