"""Planned frames of MP4 files by seeking: sample tables give each frame's bytes and its last keyframe, so nothing else is read.

``mp4_index`` walks the boxes of a file by ranged reads and reads its ``moov`` box alone; one row for each track holds the sample
tables as arrays. Which frames are wanted is then a column expression, and so are the packets from a wanted frame's last
keyframe up to the frame itself, which a decoder needs. ``read_packets`` reads those byte ranges, spread by file and slot.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import frame_indices, let
from framewright.parts import in_parts, lists
from framewright.sources.ranged import open_ranged, reader

#: Bytes of a ``moov`` box at most: some millions of frames. Ranges closer than this are read at once.
MOOV_BYTES, GAP = 256 << 20, 1 << 16
#: Planned frames of one file that are read by one task, which opens it once.
SLOTS = 16
INDEX = pa.schema([
    ("path", pa.string()), ("track", pa.int32()), ("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("n_frames", pa.int64()),
    ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("pts", pa.list_(pa.int64())), ("decode", pa.list_(pa.int32())), ("keys", pa.list_(pa.int32())),
    ("status", pa.string()), ("error", pa.string()),
])
INDEX_DDL = "path string, track int, kind string, codec string, timescale long, n_frames long, offsets array<bigint>, sizes array<bigint>, pts array<bigint>, decode array<int>, keys array<int>, status string, error string"


class Damaged(ValueError):
    """Not an MP4 file whose sample tables can be read."""


@dataclass
class Track:
    """Sample tables in decoding order. ``decode``: for each frame in order of presentation its place in decoding order; ``keys``: for
    each sample the place of the last keyframe at or before it, -1 if there is none."""

    kind: str
    codec: str
    timescale: int
    offsets: np.ndarray
    sizes: np.ndarray
    pts: np.ndarray
    decode: np.ndarray
    keys: np.ndarray
    width: int = 0
    height: int = 0


def boxes(read: Callable[[int, int], bytes], start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(type, start, end)`` of the bodies of the boxes between two places. A box that reaches beyond the end is damage."""
    at = start
    while at < end:
        head = read(at, 16)
        if len(head) < 8 or at + 8 > end:
            raise Damaged("a box header is cut")
        size, kind = struct.unpack(">I4s", head[:8])
        body = at + 8
        if size == 1:
            if len(head) < 16:
                raise Damaged("a box header is cut")
            size, body = struct.unpack(">Q", head[8:])[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise Damaged(f"box {kind!r} of {size} bytes doesn't fit")
        yield kind, body, stop
        at = stop


def parse_mp4(read: Callable[[int, int], bytes], length: int) -> list[Track]:
    """The tracks of a file in order, from ``read(at, n)``; raises :class:`Damaged`. Fragmented files aren't read."""
    first = read(0, 8)[4:8]
    if first not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
        raise Damaged("no MP4 box at the start")
    at = next(((a, b) for kind, a, b in boxes(read, 0, length) if kind == b"moov"), None)
    if at is None:
        raise Damaged("no moov box")
    if at[1] - at[0] > MOOV_BYTES:
        raise Damaged(f"its moov box has {at[1] - at[0]} bytes")
    moov = read(at[0], at[1] - at[0])
    tracks = [_track(moov, a, b, length) for kind, a, b in _inner(moov, 0, len(moov)) if kind == b"trak"]
    if any(kind == b"mvex" for kind, _, _ in _inner(moov, 0, len(moov))) and not any(len(t.sizes) for t in tracks):
        raise Damaged("it is fragmented")
    return tracks


def _inner(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    return boxes(lambda at, n: data[at : min(at + n, end)], start, end)


def _table(data: bytes, at: tuple[int, int] | None, kinds: str, skip: int = 8) -> np.ndarray:
    """The entries of a full box with a count before them, as rows; none where there is no box."""
    entry = np.dtype([(f"f{i}", f">{k}") for i, k in enumerate(kinds.split())])
    if at is None:
        return np.zeros(0, dtype=entry)
    if at[1] - at[0] < skip:
        raise Damaged("a sample table is cut")
    count = struct.unpack(">I", data[at[0] + skip - 4 : at[0] + skip])[0]
    if at[0] + skip + count * entry.itemsize > at[1]:
        raise Damaged("a sample table is cut")
    return np.frombuffer(data, dtype=entry, count=count, offset=at[0] + skip)


def _track(data: bytes, start: int, end: int, length: int) -> Track:
    found: dict[bytes, tuple[int, int]] = {}

    def walk(a: int, b: int) -> None:
        for kind, x, y in _inner(data, a, b):
            if kind in (b"mdia", b"minf", b"stbl"):
                walk(x, y)
            else:
                found.setdefault(kind, (x, y))

    walk(start, end)
    missing = [k.decode() for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz") if k not in found]
    if missing or not (b"stco" in found or b"co64" in found):
        raise Damaged(f"a track lacks {missing or 'chunk offsets'}")
    a, b = found[b"mdhd"]
    wide = data[a : a + 1] == b"\x01"
    if b - a < (28 if wide else 16) or found[b"hdlr"][1] - found[b"hdlr"][0] < 12:
        raise Damaged("a media header is cut")
    timescale = struct.unpack(">I", data[a + 20 : a + 24] if wide else data[a + 12 : a + 16])[0]
    kind = data[found[b"hdlr"][0] + 8 :][:4].decode("latin-1")
    a, b = found[b"stsd"]
    codec = data[a + 12 : a + 16].decode("latin-1") if b - a >= 16 else ""
    width, height = struct.unpack(">HH", data[a + 40 : a + 44]) if kind == "vide" and b - a >= 44 else (0, 0)

    a, b = found[b"stsz"]
    if b - a < 12:
        raise Damaged("a sample table is cut")
    each, n = struct.unpack(">II", data[a + 4 : a + 12])
    if each:
        if each * n > length:
            raise Damaged(f"{n} samples of {each} bytes don't fit in the file")
        sizes = np.full(n, each, dtype=np.int64)
    else:
        sizes = _table(data, (a, b), "u4", 12)["f0"].astype(np.int64)
    chunks = (_table(data, found[b"co64"], "u8") if b"co64" in found else _table(data, found[b"stco"], "u4"))["f0"].astype(np.int64)
    offsets = _offsets(_table(data, found[b"stsc"], "u4 u4 u4"), chunks, sizes)
    if len(sizes) and ((offsets < 0) | (offsets + sizes > length)).any():
        raise Damaged("samples lie beyond the end of the file")
    dts = _runs(_table(data, found[b"stts"], "u4 u4"), n)
    steps = np.cumsum(dts) - dts
    version = data[found[b"ctts"][0]] if b"ctts" in found else 0
    shift = _runs(_table(data, found[b"ctts"], "u4 i4" if version else "u4 u4"), n) if b"ctts" in found else 0
    pts = steps + shift
    place = np.arange(n)
    if b"stss" in found:
        marks = _table(data, found[b"stss"], "u4")["f0"].astype(np.int64) - 1
        if len(marks) and (marks.min() < 0 or marks.max() >= n):
            raise Damaged("a keyframe is no sample")
        keyed = np.full(n, -1)
        keyed[marks] = marks
        keys = np.maximum.accumulate(keyed) if n else keyed
    else:
        keys = place
    return Track(kind, codec, timescale, offsets, sizes, pts, np.argsort(pts, kind="stable"), keys, width, height)


def _runs(table: np.ndarray, n: int) -> np.ndarray:
    counts = table["f0"].astype(np.int64)
    if counts.sum() != n:
        raise Damaged(f"a table of times has {counts.sum()} samples of {n}")
    return np.repeat(table["f1"].astype(np.int64), counts)


def _offsets(runs: np.ndarray, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of each sample, from the runs of chunks with as many samples each."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    first, per = runs["f0"].astype(np.int64) - 1, runs["f1"].astype(np.int64)
    if not len(first) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(chunks):
        raise Damaged("its chunks aren't in order")
    per_chunk = np.repeat(per, np.diff(np.append(first, len(chunks))))
    if per_chunk.sum() != len(sizes):
        raise Damaged(f"its chunks hold {per_chunk.sum()} samples of {len(sizes)}")
    before = np.cumsum(sizes) - sizes
    start = np.cumsum(per_chunk) - per_chunk
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    return chunks[chunk] + before - before[np.minimum(start, len(sizes) - 1)][chunk]


def mp4_index(files: DataFrame) -> DataFrame:
    """One row for each track of each file in ``files(path, length)``: its kind (``vide``, ``soun``), codec, clock, number of frames, and sample tables
    in decoding order (see ``Track``). A file that can't be read is one row with ``status`` ``error``."""

    def tracks(path: str, length: int) -> Iterator[tuple[int, tuple]]:
        try:
            with open_ranged(path) as f:
                found = parse_mp4(reader(f, length), length)
        except (OSError, ValueError) as e:
            yield len(path), (path, *[None] * 10, "error", f"{type(e).__name__}: {e}")
            return
        for i, t in enumerate(found):
            yield 32 * len(t.sizes), (path, i, t.kind, t.codec, t.timescale, len(t.sizes), t.offsets, t.sizes, t.pts, t.decode, t.keys, "ok", None)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lists(x, kind) if pa.types.is_list(kind) else pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), INDEX.types, strict=True)], schema=INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_parts((row for file in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in tracks(*file)), made)

    return files.select("path", F.col("length").cast("bigint")).mapInArrow(run, INDEX_DDL)


def planned_packets(index: DataFrame, n_want: int = 16) -> DataFrame:
    """``path, track, slot, frame_idx, pts, offsets, sizes``: evenly spread frames of each readable video track, each with the byte ranges of
    the packets from its last keyframe up to itself, which is the last. A frame without a keyframe before it stands alone; a track without frames has no rows."""
    video = index.where((F.col("status") == "ok") & (F.col("kind") == "vide"))

    def ranges(frame: Column, slot: Column) -> Column:
        def since(d: Column, k: Column) -> Column:
            return F.struct(slot.alias("slot"), frame.alias("frame_idx"), F.get("pts", d).alias("pts"), F.slice("offsets", k + 1, d - k + 1).alias("offsets"), F.slice("sizes", k + 1, d - k + 1).alias("sizes"))

        def keyed(d: Column) -> Column:
            return let(F.get("keys", d), lambda k: since(d, F.when(k < 0, d).otherwise(k)))

        return let(F.get("decode", frame.cast("int")), keyed)

    # the slots are made before they become rows, so that no row repeats the sample tables
    return video.select("path", "track", F.inline(F.transform(frame_indices(F.col("n_frames"), n_want), ranges)))


def spans(offsets: np.ndarray | list[int], sizes: np.ndarray | list[int], gap: int = GAP) -> list[tuple[int, int]]:
    """Few ranges that hold all of these, apart by more than ``gap``."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(np.asarray(offsets).tolist(), np.asarray(sizes).tolist(), strict=True)):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def read_packets(planned: DataFrame, gap: int = GAP) -> DataFrame:
    """``planned`` without its ranges, with the ``packets`` that they hold, read by the tasks that the rows are dealt to."""
    kept = [c for c in planned.columns if c not in ("offsets", "sizes")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in planned.select(*kept).schema)
    run_of = F.floor(F.col("slot") / SLOTS)
    dealt = planned.select(*kept, "offsets", "sizes").repartition("path", run_of).sortWithinPartitions("path", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
            nonlocal opened, f
            offsets, sizes = (batch.column(len(kept) + k).to_pylist() for k in (0, 1))
            for i, path in enumerate(batch.column(kept.index("path")).to_pylist()):
                if opened != path:
                    if f is not None:
                        f.close()
                    opened, f = path, open_ranged(path)
                got = []
                for a, b in spans(offsets[i], sizes[i], gap):
                    f.seek(a)
                    got.append((a, f.read(b - a)))
                packets = []
                for at, n in zip(offsets[i], sizes[i], strict=True):
                    a, data = next((a, x) for a, x in got if a <= at and at + n <= a + len(x))
                    packets.append(data[at - a : at - a + n])
                yield sum(sizes[i]), (i, packets)

        try:
            for batch in batches:

                def made(part: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                    own = (c.slice(part[0][0], len(part)) for c in batch.columns[: len(kept)])
                    return pa.RecordBatch.from_arrays([*own, pa.array([x for _, x in part], pa.list_(pa.binary()))], [*kept, "packets"])

                yield from in_parts(rows(batch), made)
        finally:
            if f is not None:
                f.close()

    return dealt.mapInArrow(run, f"{types}, packets array<binary>")


def mp4_bytes(frames: list[bytes], keyframe: list[bool], order: list[int] | None = None, codec: bytes = b"raw ", step: int = 40, timescale: int = 1000, per_chunk: int = 4, tail: bool = True, width: int = 0, height: int = 0) -> bytes:
    """A file with one video track, for tests and queries: packets in decoding order, ``order`` the place of each in presentation; the ``moov``
    box comes last (``tail``) or first."""

    def box(kind: bytes, *body: bytes) -> bytes:
        data = b"".join(body)
        return struct.pack(">I4s", 8 + len(data), kind) + data

    def full(kind: bytes, *body: bytes, version: int = 0) -> bytes:
        return box(kind, struct.pack(">I", version << 24), *body)

    n = len(frames)

    def moov(at: int) -> bytes:
        place, chunks = at, []
        for i, x in enumerate(frames):
            if i % per_chunk == 0:
                chunks.append(place)
            place += len(x)
        runs = [(1, per_chunk)] if n else []
        if n % per_chunk:
            runs = [(1, per_chunk), (n // per_chunk + 1, n % per_chunk)][n < per_chunk :]
        tables = [
            full(b"stsd", struct.pack(">I", 1), box(codec, b"\0" * 24, struct.pack(">HH", width, height), b"\0" * 50)), full(b"stts", struct.pack(">III", 1, n, step) if n else struct.pack(">I", 0)),
            full(b"stss", struct.pack(">I", sum(keyframe)), *(struct.pack(">I", i + 1) for i, k in enumerate(keyframe) if k)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", 0, n), *(struct.pack(">I", len(x)) for x in frames)), full(b"co64", struct.pack(">I", len(chunks)), *(struct.pack(">Q", c) for c in chunks)),
        ]
        if order is not None:
            tables.append(full(b"ctts", struct.pack(">I", n), *(struct.pack(">Ii", 1, (order[i] - i) * step) for i in range(n)), version=1))
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, timescale, n * step), b"\0" * 4), full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 13), box(b"minf", box(b"stbl", *tables)))
        return box(b"moov", full(b"mvhd", b"\0" * 96), box(b"trak", media))

    head, data = box(b"ftyp", b"isom", b"\0" * 4), box(b"mdat", *frames)
    if tail:
        return head + data + moov(len(head) + 8)
    return head + moov(len(head) + len(moov(0)) + 8) + data
