"""Media columns in Matroska: texts as 8-bit samples in, packet tables with timestamps, tracks and byte ranges out.

Elements are parsed by their variable-length ids and sizes: clusters, simple blocks and block groups, all four kinds of lacing,
cues. The payload is read back from the packets' byte ranges, so what is hashed is what was stored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.common import batches_by_bytes

# Element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, TRACK_NUMBER, CODEC, RATE, CHANNELS, BITS = 0x2AD7B1, 0xD7, 0x86, 0xB5, 0x9F, 0x6264
NESTED = frozenset([SEGMENT, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_PLACES, TRACKS, TRACK, AUDIO, INFO])
#: What ends a cluster or segment of unknown size.
TOP = frozenset([EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES])

#: Samples of a packet, packets of a block, blocks of a cluster, samples a second.
PACKET, LACED, BLOCKS, HERTZ = 576, 8, 32, 8000
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones mean unknown, so they are avoided."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of a block behind their sizes."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0]) if len(frames) > 1 else b""
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


HEADER = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
AUDIO_TRACK = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + number(CHANNELS, 1) + number(BITS, 8))))
ABOUT = element(INFO, number(SCALE, 1_000_000) + element(0x4D80, b"framewright") + element(0x5741, b"framewright"))


def mux(payload: bytes, lacing: int = FIXED) -> bytes:
    """A file of one 8-bit track; ``payload`` has a positive multiple of ``PACKET`` bytes."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    step, each = PACKET * 1000 // HERTZ, LACED if lacing else 1
    clusters, cues, at = [], [], len(ABOUT) + len(AUDIO_TRACK)
    for c in range(0, len(packets), BLOCKS * LACED):
        body = number(CLUSTER_TIME, c * step)
        for b in range(c, min(len(packets), c + BLOCKS * LACED), each):
            frames = packets[b : min(b + each, c + BLOCKS * LACED)]
            kind = lacing if len(frames) > 1 else NO_LACING
            body += element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (b - c) * step, 0x80 | kind << 1 if kind != FIXED else 0x84) + lace(frames, kind))
        clusters.append(element(CLUSTER, body))
        cues.append(element(CUE, number(CUE_TIME, c * step) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return HEADER + element(SEGMENT, ABOUT + AUDIO_TRACK + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """``packets``: (track, timestamp in ms, first byte, bytes, is a keyframe); ``cues``: (time, track, byte of the cluster)."""

    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    codecs: dict[int, str] = field(default_factory=dict)


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """``(value, next place)``; None for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the file ends inside an integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n ^= 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames, from its lacing on."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == FIXED:
        each, odd = divmod(end - at, n)
        if odd:
            raise ValueError("frames of one size don't fill their block")
        sizes = [each] * n
    else:
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                first = at
                size, at = read_vint(data, at, False)
                if size is None:
                    size = (1 << 7 * (at - first)) - 1
                if i:
                    size += sizes[-1] - ((1 << 7 * (at - first) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


@dataclass
class Track:
    """What says how long a frame of PCM lasts."""

    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    bits: int = 8

    def ms(self, n_bytes: int) -> float:
        """Milliseconds of a frame in a lace; 0 where that can't be told from its bytes."""
        each = self.channels * self.bits * self.rate
        return n_bytes * 8000.0 / each if self.codec.startswith("A_PCM") and each > 0 else 0.0


def demux(data: bytes) -> Media:
    """All packets and cues of a file. Elements it doesn't know are skipped; what is damaged, no Matroska file, or beyond the
    ranges of the packet table raises ValueError, IndexError, OverflowError or struct.error."""
    if not data.startswith(EBML.to_bytes(4, "big")):
        raise ValueError("not a Matroska file")
    media, scale, segment, cluster_time, track, cue = Media(), 1_000_000, None, 0, 0, [0, 0, 0]
    tracks: dict[int, Track] = {}
    at, ends, group, referring = 0, [], 0, False

    def whole(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def leave() -> None:
        if ends.pop()[0] == CUE_PLACES:
            media.cues.append((cue[0] * scale // 1_000_000, cue[1], segment + cue[2]))

    while at < len(data):
        while ends and at >= ends[-1][1]:
            leave()
        ident, body = read_vint(data, at, True)
        while ends and ends[-1][2] and ident in TOP:  # an unknown size ends with the next element of its level
            leave()
        size, body = read_vint(data, body, False)
        end = len(data) if size is None else body + size
        if end > len(data):
            raise ValueError(f"the element at byte {at} is longer than the file")
        if ident in NESTED:
            if ident == SEGMENT:
                segment = body
            elif segment is None:
                raise ValueError("an element outside the segment")
            elif ident == BLOCK_GROUP:
                group, referring = len(media.packets), False
            ends.append((ident, end, size is None and ident == CLUSTER))
            if end == body and ident == CUE_PLACES:
                ends.pop()
            at = body
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            number_, p = read_vint(data, body, False)
            time, flags = struct.unpack_from(">hB", data, p)
            if number_ is None or number_ >= 1 << 31:
                raise ValueError(f"the block at byte {at} has no track number that fits")
            frames = _frames(data, p + 3, end, (0, XIPH, FIXED, EBML_LACING)[flags >> 1 & 3])
            later = 0.0
            for first, n in frames:
                ms = int((cluster_time + time) * scale / 1e6 + later)
                if abs(ms) >= 1 << 62:
                    raise ValueError(f"the block at byte {at} has a time that doesn't fit")
                media.packets.append((number_, ms, first, n, bool(flags & 0x80) if ident == SIMPLE_BLOCK else not referring))
                later += tracks.get(number_, Track()).ms(n)
        elif ident == CLUSTER_TIME:
            cluster_time = whole(body, end)
        elif ident == REFERENCE:
            referring = True
            media.packets[group:] = [(*p[:4], False) for p in media.packets[group:]]
        elif ident == SCALE:
            scale = whole(body, end)
        elif ident == TRACK_NUMBER:
            track = whole(body, end)
        elif ident == CODEC:
            media.codecs[track] = data[body:end].decode("ascii", "replace")
            tracks.setdefault(track, Track()).codec = media.codecs[track]
        elif ident == RATE:
            tracks.setdefault(track, Track()).rate = struct.unpack(">d" if end - body == 8 else ">f", data[body:end])[0]
        elif ident == CHANNELS:
            tracks.setdefault(track, Track()).channels = whole(body, end)
        elif ident == BITS:
            tracks.setdefault(track, Track()).bits = whole(body, end)
        elif ident == CUE_TIME:
            cue[0] = whole(body, end)
        elif ident == CUE_TRACK:
            cue[1] = whole(body, end)
        elif ident == CUE_CLUSTER:
            cue[2] = whole(body, end)
        at = end
    while ends:
        leave()
    if segment is None:
        raise ValueError("a file without segment")
    return media


def features(payload: bytes, packets: int) -> str:
    """Packets, mean, root mean square and peak around the middle, zero crossings: whole numbers, in thousandths where they are means."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={packets};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n};peak={int(np.abs(x).max(initial=0))};crossings={crossings}"


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as UTF-8, filled with bytes 255 to a positive multiple of ``PACKET``, in one Matroska
    file. A null text counts as empty; repeated rows each give a file; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, 1):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            files = [mux(r + b"\xff" * (-len(r) % PACKET if r else PACKET)) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PACKETS = "array<struct<track:int,timestamp:bigint,start:bigint,size:bigint,keyframe:boolean>>"


def decode_media(files: DataFrame) -> DataFrame:
    """``files(doc_id, n_bytes, media)`` with ``packets``, ``payload`` (the bytes of all packets of the first track, in order) and ``feature``.

    A null, empty or damaged file, or one with tracks or times beyond the packet table, has null packets, payload and feature and says why
    in ``error``; repeated rows each give a row, an empty table an empty table; other columns are left out.
    """
    fields = [("track", pa.int32()), ("timestamp", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_())]
    kind = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, 2):
            offsets, columns, payloads, feature, errors = [0], [[] for _ in fields], [], [], []
            nulls = []
            for data in part.column(2).to_pylist():
                try:
                    if data is None:
                        raise ValueError("no file")
                    packets = demux(data).packets
                    first = min((p[0] for p in packets), default=0)
                    payload = b"".join(data[s : s + n] for track, _, s, n, _ in packets if track == first)
                    for c, x in zip(columns, zip(*packets, strict=True), strict=False):
                        c.extend(x)
                    out = (payload, features(payload, len(packets)), None)
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    out = (None, None, str(e))
                nulls.append(out[0] is None)
                offsets.append(len(columns[0]))
                for to, x in zip((payloads, feature, errors), out, strict=True):
                    to.append(x)
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(nulls, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists.cast(kind), pa.array(payloads, pa.binary()), pa.array(feature, pa.string()), pa.array(errors, pa.string())], ["doc_id", "n_bytes", "media", "packets", "payload", "feature", "error"])

    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, packets {PACKETS}, payload binary, feature string, error string"
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def packet_table(decoded: DataFrame) -> DataFrame:
    """One row for each packet: ``doc_id, packet, track, timestamp, start, size, keyframe``."""
    return decoded.select("doc_id", F.posexplode("packets").alias("packet", "p")).select("doc_id", "packet", "p.*")


def cue_table(files: DataFrame) -> DataFrame:
    """One row for each cue of each readable file in ``files(doc_id, media)``: ``doc_id, cue, time, track, cluster``, the byte at which the cue's
    cluster begins. Null and damaged files have none."""
    kind = pa.list_(pa.struct([("time", pa.int64()), ("track", pa.int64()), ("cluster", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, 1):
            found = []
            for data in part.column(1).to_pylist():
                try:
                    cues = demux(data).cues if data is not None else []
                    found.append(pa.array([{"time": t, "track": n, "cluster": at} for t, n, at in cues], kind.value_type).to_pylist())
                except (ValueError, IndexError, OverflowError, struct.error):
                    found.append([])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "cues"])

    rows = files.select("doc_id", "media").mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, cues array<struct<time:bigint,track:bigint,cluster:bigint>>")
    return rows.select("doc_id", F.posexplode("cues").alias("cue", "c")).select("doc_id", "cue", "c.*")


def sought(wanted: DataFrame, cues: DataFrame, packets: DataFrame) -> DataFrame:
    """``doc_id, time, cluster, packet, timestamp, start, size`` for each of ``wanted(doc_id, time)``: the cluster of the last cue at or before the
    time, and the first packet from there on that isn't earlier than the time (null if none is). ``cues`` and ``packets`` are the tables of
    ``cue_table`` and ``packet_table``; repeated wishes each get a row.

    Cues are joined as of the time by one sorted pass over both, a file at a time; of packets only those between the wish and the cue after it
    are compared.
    """
    none = F.lit(None).cast("bigint")
    own = wanted.select("doc_id", "time", F.lit(1).alias("_w"), none.alias("cluster"))
    both = own.unionByName(cues.select("doc_id", "time", F.lit(0).alias("_w"), "cluster"))
    order = W.partitionBy("doc_id").orderBy("time", "_w")
    after = W.partitionBy("doc_id").orderBy(F.desc("time"), F.desc("_w")).rowsBetween(W.unboundedPreceding, -1)
    placed = both.withColumn("cluster", F.last("cluster", True).over(order)).withColumn("_until", F.last(F.when(F.col("_w") == 0, F.col("time")), True).over(after))
    placed = placed.where("_w = 1").withColumn("_n", F.monotonically_increasing_id()).drop("_w")
    near = (F.col("timestamp") >= F.col("time")) & (F.col("start") > F.coalesce("cluster", F.lit(-1))) & (F.col("_until").isNull() | (F.col("timestamp") <= F.col("_until")))
    met = placed.join(packets.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & near, "left")
    first = F.min(F.when(F.col("packet").isNotNull(), F.struct("timestamp", "packet", "start", "size"))).alias("p")
    return met.groupBy("_n", "doc_id", "time", "cluster").agg(first).select("doc_id", "time", "cluster", "p.packet", "p.timestamp", "p.start", "p.size")


def op5_matroska(spark, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` through Matroska and back: sizes, digests of what was read back, features."""
    back = decode_media(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.size("packets").alias("n_packets"),
    )
