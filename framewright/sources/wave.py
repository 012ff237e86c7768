"""WAVE files as rows of sample blocks.

Headers are walked by ranged reads, so a file of any length costs a few kilobytes; its blocks are byte ranges, exploded as small rows,
spread over the cluster and read where they land. No task and no row holds a file. A store that only Spark can read is
served by ``wave_blocks_of``, which takes contents as ``binaryFile`` gives them. Both give the same rows.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.parts import in_parts
from framewright.sources.files import write_files
from framewright.sources.ranged import open_ranged, reader

#: Format tags and the largest size of a chunk, which stands for "to the end". Fixed values.
PCM, IEEE_FLOAT, EXTENSIBLE, OPEN_END = 1, 3, 0xFFFE, 0xFFFFFFFF
#: Samples of a block.
BLOCK = 1 << 16
HEADER = "rate int, channels int, bits int, floats boolean, data_start long, total long, status string, error string"
BLOCKS = "path string, block int, start long, total long, rate int, samples array<float>"


class Damaged(ValueError):
    """Not a WAVE file that can be read whole."""


@dataclass(frozen=True)
class Wave:
    """``total``: samples by channel; ``floats``: whether samples are floating-point numbers."""

    rate: int
    channels: int
    bits: int
    floats: bool
    data_start: int
    total: int

    @property
    def stride(self) -> int:
        return self.channels * self.bits // 8


def parse_wave(read: Callable[[int, int], bytes], length: int, keep_truncated: bool = False) -> Wave:
    """The format and place of the samples, from ``read(at, n)``. Chunks of other kinds are skipped; raises :class:`Damaged`.

    RIFF and RF64; integers of 8, 16, 24 and 32 bits, floats of 32 and 64, plain or extensible. A data chunk whose size is the largest number
    reaches to the end of the file; one that states more than there is raises, or ends with the file if ``keep_truncated``.
    """
    head = read(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise Damaged("no RIFF or RF64 header of kind WAVE")
    at, found, long_size = 12, None, None
    while True:
        chunk = read(at, 8)
        if len(chunk) < 8:
            raise Damaged("it ends before its data chunk")
        name, size = struct.unpack("<4sI", chunk)
        at += 8
        if name == b"ds64":
            body = read(at, 16)
            if len(body) < 16:
                raise Damaged("its ds64 chunk is cut")
            long_size = struct.unpack("<QQ", body)[1]
        elif name == b"fmt ":
            found = _format(read(at, min(size, 40)))
        elif name == b"data":
            break
        at += size + size % 2
    if found is None:
        raise Damaged("its data chunk comes before its format")
    rate, channels, bits, floats = found
    left = max(0, length - at)
    if size == OPEN_END:
        size = left if long_size is None else long_size
    if size > left and not keep_truncated:
        raise Damaged(f"truncated: {size} bytes of samples are stated, {left} are there")
    return Wave(rate, channels, bits, floats, at, min(size, left) // (channels * bits // 8))


def _format(body: bytes) -> tuple[int, int, int, bool]:
    if len(body) < 16:
        raise Damaged("its format chunk is cut")
    tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
    if tag == EXTENSIBLE:
        if len(body) < 26:
            raise Damaged("its extensible format is cut")
        tag = struct.unpack("<H", body[24:26])[0]
    if (tag, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (IEEE_FLOAT, 32), (IEEE_FLOAT, 64)}:
        raise Damaged(f"samples of format {tag} with {bits} bits aren't read here")
    if not channels or not rate or align != channels * bits // 8:
        raise Damaged(f"{channels} channels at {rate} Hz in frames of {align} bytes make no sense")
    return rate, channels, bits, tag == IEEE_FLOAT


def samples_of(data: bytes, bits: int, floats: bool, channels: int) -> np.ndarray:
    """float32 samples by time and channel; integers are scaled to -1 up to 1."""
    if floats:
        x = np.frombuffer(data, dtype=f"<f{bits // 8}").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(data, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
        x = ((wide.view("<i4").reshape(-1) >> 8) / 2.0**23).astype(np.float32)
    else:
        x = (np.frombuffer(data, dtype=f"<i{bits // 8}") / 2.0 ** (bits - 1)).astype(np.float32)
    return x.reshape(-1, channels)


def _mono(x: np.ndarray) -> np.ndarray:
    return x[:, 0] if x.shape[1] == 1 else x.mean(axis=1, dtype=np.float64).astype(np.float32)


def wave_headers(files: DataFrame, keep_truncated: bool = False) -> DataFrame:
    """``path`` with the header of each file in ``files(path, length)``; one that can't be read has nulls, ``status`` ``error`` and the ``error``.
    (Spark's own listing leaves files of no bytes out.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = {"path": path, "status": "ok"}
                try:
                    with open_ranged(path) as f:
                        w = parse_wave(reader(f, length), length, keep_truncated)
                    row |= {"rate": w.rate, "channels": w.channels, "bits": w.bits, "floats": w.floats, "data_start": w.data_start, "total": w.total}
                except (OSError, ValueError) as e:
                    row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, HEADERS)

    return files.select("path", F.col("length").cast("bigint")).mapInArrow(run, f"path string, {HEADER}")


HEADERS = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("floats", pa.bool_()), ("data_start", pa.int64()), ("total", pa.int64()), ("status", pa.string()), ("error", pa.string())])


def _rows(rows: list[tuple[str, int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
    path, block, start, total, rate, samples = zip(*rows, strict=True)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in samples])]).astype(np.int32)
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    columns = [pa.array(x, k) for x, k in zip((path, block, start, total, rate), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(samples)))], ["path", "block", "start", "total", "rate", "samples"])


def wave_blocks(headers: DataFrame, block: int = BLOCK) -> DataFrame:
    """``path, block, start, total, rate, samples`` of every readable file in ``wave_headers``: mono (the mean of the channels) float32.

    Each row is one ranged read of ``block`` samples at most, in whatever task it was dealt to. A file without samples has no rows.
    """
    last = F.floor((F.col("total") - 1) / block)
    ok = headers.where((F.col("status") == "ok") & (F.col("total") > 0))
    ranges = ok.select("path", "rate", "channels", "bits", "floats", "data_start", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    ranges = ranges.withColumn("block", F.col("block").cast("int")).repartition("path", "block").sortWithinPartitions("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None

        def rows() -> Iterator[tuple[int, tuple]]:
            nonlocal opened, f
            for batch in batches:
                for path, rate, channels, bits, floats, data_start, total, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if opened != path:
                        if f is not None:
                            f.close()
                        opened, f = path, open_ranged(path)
                    stride, start = channels * bits // 8, k * block
                    n = min(block, total - start)
                    f.seek(data_start + start * stride)
                    data = f.read(n * stride)
                    if len(data) < n * stride:
                        raise Damaged(f"{opened} got shorter while it was read")
                    yield 4 * n, (path, k, start, total, rate, _mono(samples_of(data, bits, floats, channels)))

        try:
            yield from in_parts(rows(), _rows)
        finally:
            if f is not None:
                f.close()

    return ranges.mapInArrow(run, BLOCKS)


def wave_blocks_of(files: DataFrame, block: int = BLOCK, keep_truncated: bool = False) -> DataFrame:
    """The rows of ``wave_blocks`` from ``files(path, content)``, each file in the task that holds its row, with ``status`` and ``error``: a file
    that can't be read is one row with nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer()) if content.is_valid else b""
                try:
                    w = parse_wave(reader(io.BytesIO(data), len(data)), len(data), keep_truncated)
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "status": "error", "error": f"{type(e).__name__}: {e}"}], CONTENT)
                    continue
                for k, start in enumerate(range(0, w.total, block)):
                    at = w.data_start + start * w.stride
                    x = samples_of(data[at : at + min(block, w.total - start) * w.stride], w.bits, w.floats, w.channels)
                    row = _rows([(path, k, start, w.total, w.rate, _mono(x))])
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array(["ok"]), pa.nulls(1, pa.string())], CONTENT.names)

    return files.select("path", "content").mapInArrow(run, f"{BLOCKS}, status string, error string")


CONTENT = pa.schema([("path", pa.string()), ("block", pa.int32()), ("start", pa.int64()), ("total", pa.int64()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("status", pa.string()), ("error", pa.string())])


def wave_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono file of samples in -1 to 1, which are rounded half to even and cut at the ends."""
    data = np.clip(np.rint(np.asarray(samples, dtype=np.float64) * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def write_waves(tracks: DataFrame, folder: str, name: str, samples: str, rate: int, of: Callable[[pa.Scalar], np.ndarray] | None = None) -> DataFrame:
    """``path, length`` of one 16-bit file for each row (see ``write_files``). ``of`` makes the samples of a value of any other kind, in the
    task that writes the file, so that only one track's samples are held."""

    def encoded(x: pa.Scalar) -> bytes:
        values = of(x) if of else x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
        return wave_bytes(values, rate)

    numbers = of or tracks.schema[samples].dataType.simpleString() in ("array<float>", "array<double>")
    rows = tracks.select(F.col(name).alias("name"), (F.col(samples) if numbers else F.col(samples).cast("array<double>")).alias("samples"))
    return write_files(rows, folder, "name", "samples", ".wav", encoded)
