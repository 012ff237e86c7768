"""Signal processing over tables of sample blocks: ``track, start, total, samples`` rows, in any order and of any lengths.

What a block needs of its neighbours is sent to it as pieces (``reblock``), so every transform is one shuffle of the samples and then a
row at a time: no task and no row holds a track, and a track of any length is spread as many short ones are. Each operator
gives the same samples whatever the blocks were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.parts import in_parts, lists

#: Samples of a block that is made here, about.
BLOCK = 1 << 16
#: The resampling filter: zero crossings on each side, and the shape of its Kaiser window.
ZEROS, BETA = 16, 8.0
#: Frames of the gate and of the mel patches. The latter are fixed values: 25 ms by 10 ms at 16 kHz, 64 bands, 96 frames by 48.
GATE_FFT, GATE_HOP = 1024, 256
MEL_FRAME, MEL_HOP, MEL_FFT, MEL_BANDS, MEL_LOW, MEL_HIGH, MEL_OFFSET, PATCH, PATCH_HOP = 400, 160, 512, 64, 125.0, 7500.0, 0.001, 96, 48


def reblock(blocks: DataFrame, keys: list[str], size: int, before: int = 0, after: int = 0, last: int | None = None) -> DataFrame:
    """``keys, total, k, first, samples``: for each multiple ``k * size`` below the track's length the samples from ``before`` samples ahead of
    it to ``size + after`` behind it, as far as there are any; ``first`` is the place of the first of them.

    ``last``: the greatest ``k`` by the track's length is ``floor((total + last) / size)`` instead. The input's rows are cut into pieces before
    they are shuffled; only the ``before + after`` samples around a block's ends travel twice. Keys and block numbers deal the rows, so a
    long track is spread.
    """
    n = F.size("samples").cast("bigint")
    top = F.floor((F.col("total") + (last if last is not None else -1)) / size)
    to = F.least(top, F.floor((F.col("start") + n - 1 + before) / size))
    since = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("start") - size - after + 1) / size))
    rows = blocks.where((n > 0) & (since <= to)).select(*keys, "start", "total", "samples", F.explode(F.sequence(since, to)).alias("k"))
    lo = F.greatest(F.col("start"), F.col("k") * size - before)
    hi = F.least(F.col("start") + F.size("samples"), F.col("k") * size + size + after)
    piece = F.slice("samples", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = rows.where(hi > lo).select(*keys, "total", "k", F.struct(lo.alias("at"), piece.alias("x")).alias("piece"))
    joined = pieces.groupBy(*keys, "total", "k").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return joined.select(*keys, "total", "k", F.col("p")[0]["at"].alias("first"), F.flatten(F.col("p.x")).alias("samples"))


def by_row(df: DataFrame, keys: list[str], work: Callable[..., dict | None], fields: str, extra: str | None = None) -> DataFrame:
    """``keys`` and ``fields`` from ``work(k, first, total, samples)`` on each row of ``reblock``; None leaves the row out. ``extra`` names one
    more column of arrays, which ``work`` gets last."""
    schema = pa.schema([(name, _arrow(kind)) for name, kind in (f.split(" ", 1) for f in _split(fields))])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    arrays = ["samples", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, first, total = (batch.column(len(keys) + i).to_pylist() for i in range(3))
            columns = [batch.column(len(keys) + 3 + i) for i in range(len(arrays))]
            flat = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in columns]

            def rows() -> Iterator[tuple[int, tuple]]:
                for i in range(batch.num_rows):
                    x, *more = (values[at[i] : at[i + 1]].astype(np.float64) for at, values in flat)
                    out = work(k[i], first[i], total[i], np.nan_to_num(x), *more)
                    if out is not None:
                        n = len(next(iter(out.values())))
                        yield sum(sum(map(len, v)) if pa.types.is_list(kind) else n for v, kind in zip((out[f.name] for f in schema), schema.types, strict=True)) * 8, (i, n, out)

            def made(part: list[tuple]) -> pa.RecordBatch:
                place = pa.array(np.repeat([i for i, _, _ in part], [n for _, n, _ in part]))
                values = [[x for _, _, out in part for x in out[f.name]] for f in schema]
                own = [batch.column(i).take(place) for i in range(len(keys))]
                return pa.RecordBatch.from_arrays([*own, *(lists(v, f.type) if pa.types.is_list(f.type) else pa.array(v, f.type) for v, f in zip(values, schema, strict=True))], [*keys, *schema.names])

            yield from in_parts(rows(), made)

    return df.select(*keys, "k", "first", "total", *arrays).mapInArrow(run, f"{types}, {fields}")


def _split(fields: str) -> list[str]:
    return [f.strip() for f in fields.split(",")]


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64()}[kind]


def window_of(first: int, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Samples ``lo`` to ``hi`` of a track of which ``x`` begins at ``first``; zeros where there are none."""
    out = np.zeros(hi - lo)
    a, b = max(lo, first), min(hi, first + len(x))
    if b > a:
        out[a - lo : b - lo] = x[a - first : b - first]
    return out


def sinc_filter(up: int, down: int, zeros: int = ZEROS, beta: float = BETA) -> tuple[np.ndarray, int]:
    """``(taps, reach)``: a Kaiser-windowed sinc by phase (``up`` rows) that cuts at the lower of both rates' halves; tap t of a phase weighs the
    sample ``t - reach + 1`` after the last one at or before the output's place. Each phase's taps sum to one."""
    cut = min(1.0, up / down)
    reach = int(np.ceil(zeros / cut))
    at = np.arange(1 - reach, reach + 1)[None, :] - np.arange(up)[:, None] / up
    taps = np.sinc(at * cut) * np.i0(beta * np.sqrt(np.clip(1 - (at / reach) ** 2, 0, None))) * (np.abs(at) <= reach)
    return taps / taps.sum(axis=1, keepdims=True), reach


def resampled(first: int, x: np.ndarray, a: int, b: int, up: int, down: int, taps: np.ndarray, reach: int) -> np.ndarray:
    """Outputs ``a`` to ``b`` of a track of which ``x`` begins at ``first`` and holds what they need."""
    if b <= a:
        return np.zeros(0)
    place = np.arange(a, b, dtype=np.int64) * down
    whole, phase = place // up, place % up
    views = np.lib.stride_tricks.sliding_window_view(window_of(first, x, int(whole[0]) - reach, int(whole[-1]) + reach + 1), 2 * reach)
    y = np.empty(b - a)
    for p in range(min(up, b - a)):
        rows = np.arange(p, b - a, up)
        y[rows] = views[whole[rows] - whole[0] + 1] @ taps[phase[p]]
    return y


def resample_array(x: np.ndarray, rate_in: int, rate_out: int = 16000) -> np.ndarray:
    """``resample`` of one whole track."""
    if rate_in == rate_out:
        return np.asarray(x, dtype=np.float32)
    up, down = rate_out // gcd(rate_in, rate_out), rate_in // gcd(rate_in, rate_out)
    return resampled(0, np.asarray(x, dtype=np.float64), 0, -(-len(x) * up // down), up, down, *sinc_filter(up, down)).astype(np.float32)


def resample(blocks: DataFrame, keys: list[str], rate_in: int, rate_out: int = 16000, block: int = BLOCK) -> DataFrame:
    """``keys, start, total, samples`` at ``rate_out``: output j stands at ``j * rate_in / rate_out``, from polyphase windowed-sinc taps over
    the samples around it (zeros beyond the track's ends); a track of n samples gives ``ceil(n * rate_out / rate_in)``."""
    up, down = rate_out // gcd(rate_in, rate_out), rate_in // gcd(rate_in, rate_out)
    taps, reach = sinc_filter(up, down)
    size = max(1, block // down) * down  # whole cycles of phases: outputs of a block are whole too

    def work(k: int, first: int, total: int, x: np.ndarray) -> dict:
        n_out = -(-total * up // down)
        a, b = k * size // down * up, min(n_out, (k + 1) * size // down * up)
        if up == down:
            return {"start": [a], "total": [n_out], "samples": [window_of(first, x, a, b).astype(np.float32)]}
        y = resampled(first, x, a, b, up, down, taps, reach)
        return {"start": [a], "total": [n_out], "samples": [y.astype(np.float32)]}

    return by_row(reblock(blocks, keys, size, reach, reach + 1), keys, work, "start long, total long, samples array<float>")


def quantize(blocks: DataFrame) -> DataFrame:
    """Samples as 16-bit integers hold them: rounded half to even in steps of 2**-15 and cut to -1 up to 1 - 2**-15."""
    step = F.transform("samples", lambda x: (F.least(F.greatest(F.bround(x.cast("double") * 32768), F.lit(-32768.0)), F.lit(32767.0)) / 32768).cast("float"))
    return blocks.withColumn("samples", step)


@cache
def hann(n: int) -> np.ndarray:
    """A periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def n_frames(total: int, n_fft: int, hop: int) -> int:
    """Frames of a track; frame f covers ``n_fft`` samples from ``(f + 1) * hop - n_fft``, so each sample lies in ``n_fft / hop`` of them."""
    return -(-(total + n_fft - hop) // hop)


def frames_of(first: int, x: np.ndarray, f0: int, f1: int, n_fft: int, hop: int) -> np.ndarray:
    """Windowed transforms of frames ``f0`` to ``f1``, by frame and bin."""
    near = window_of(first, x, (f0 + 1) * hop - n_fft, f1 * hop)
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(near, n_fft)[::hop] * hann(n_fft), axis=1)


def stft(blocks: DataFrame, keys: list[str], n_fft: int = GATE_FFT, hop: int = GATE_HOP, block: int = BLOCK) -> DataFrame:
    """``keys, frame, total, re, im`` for every frame of every track."""
    if n_fft % hop:
        raise ValueError("the hop has to divide the frame")
    size = max(1, block // hop) * hop

    def work(k: int, first: int, total: int, x: np.ndarray) -> dict | None:
        f0, f1 = k * size // hop, min(n_frames(total, n_fft, hop), (k + 1) * size // hop)
        if f1 <= f0:
            return None
        z = frames_of(first, x, f0, f1, n_fft, hop)
        return {"frame": np.arange(f0, f1), "total": np.full(f1 - f0, total), "re": list(z.real), "im": list(z.imag)}

    return by_row(reblock(blocks, keys, size, n_fft - hop, 0, last=n_fft - hop - 1), keys, work, "frame long, total long, re array<double>, im array<double>")


def overlap_add(frames: DataFrame, keys: list[str], n_fft: int = GATE_FFT, hop: int = GATE_HOP, block: int = BLOCK) -> DataFrame:
    """``keys, start, total, samples`` from the rows of ``stft``: each frame is transformed back, windowed again and added, over the sum of the
    squared windows; unchanged frames give the track back.

    A frame goes to the one or two blocks that it overlaps; a block holds ``block / hop`` frames and a few more.
    """
    size = max(1, block // hop, n_fft // hop) * hop
    weight = float((hann(n_fft) ** 2)[::hop].sum())
    end = (F.col("frame") + 1) * hop
    since, to = F.floor(F.greatest(F.lit(0).cast("bigint"), end - n_fft) / size), F.floor(F.least(end - 1, F.col("total") - 1) / size)
    rows = frames.where(since <= to).select(*keys, "total", F.explode(F.sequence(since, to)).alias("k"), F.struct("frame", "re", "im").alias("f"))
    rows = rows.groupBy(*keys, "total", "k").agg(F.array_sort(F.collect_list("f")).alias("f")).select(*keys, "k", F.lit(0).cast("bigint").alias("first"), "total", "f")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, total, f = batch.column(len(keys))[i].as_py(), batch.column(len(keys) + 2)[i].as_py(), batch.column(len(keys) + 3)[i].values
                z = np.array([f.field("re").to_pylist(), f.field("im").to_pylist()])
                y = added(np.fft.irfft(z[0] + 1j * z[1], n=n_fft, axis=1), f.field("frame").to_numpy(), k * size, min(total, (k + 1) * size), n_fft, hop) / weight
                own = [c.slice(i, 1) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array([k * size]), pa.array([total]), pa.array([y.astype(np.float32)], pa.list_(pa.float32()))], [*keys, "start", "total", "samples"])

    return rows.mapInArrow(run, f"{types}, start long, total long, samples array<float>")


def added(frames: np.ndarray, number: np.ndarray, lo: int, hi: int, n_fft: int, hop: int) -> np.ndarray:
    """The sum over samples ``lo`` to ``hi`` of windowed frames by their numbers."""
    each, since = n_fft // hop, lo // hop
    near = (0 <= (number + 1) * hop - lo) & ((number + 1) * hop <= hi + n_fft)
    place, x = number[near] - since, (frames[near] * hann(n_fft)).reshape(-1, each, hop)
    out = np.zeros((-(-hi // hop) - since + 2 * each + 2, hop))  # by steps of the hop, as many ahead of the first as a frame has
    for j in reversed(range(each)):  # a sample's frames in order
        out[place + j + 1] += x[:, j]
    return out.reshape(-1)[n_fft + lo - since * hop :][: hi - lo]


def decibels(z: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.abs(z) + 1e-10)


def noise_floor(profile: np.ndarray, n_fft: int, hop: int, deviations: float) -> np.ndarray:
    """By bin the mean of a clip's frames in decibels and so many standard deviations."""
    db = decibels(frames_of(0, profile, 0, n_frames(len(profile), n_fft, hop), n_fft, hop))
    return db.mean(axis=0) + deviations * db.std(axis=0)


def smoothing(n: int) -> np.ndarray:
    """Triangular weights that reach ``n`` to each side and sum to one."""
    w = np.concatenate([np.arange(1, n + 2), np.arange(n, 0, -1)]).astype(np.float64)
    return w / w.sum()


@dataclass(frozen=True)
class Gate:
    """A gate's frames and smoothing, from its settings in hertz and milliseconds."""

    n_fft: int
    hop: int
    over_bins: np.ndarray
    over_frames: np.ndarray
    reduction: float

    @staticmethod
    def of(rate: int, n_fft: int, hop: int, reduction: float, smooth_hz: float, smooth_ms: float) -> Gate:
        if n_fft % hop:
            raise ValueError("the hop has to divide the frame")
        return Gate(n_fft, hop, smoothing(int(smooth_hz / (rate / n_fft))), smoothing(int(smooth_ms / (1000 * hop / rate))), reduction)

    @property
    def reach(self) -> int:
        return len(self.over_frames) // 2

    def gated(self, first: int, x: np.ndarray, lo: int, hi: int, total: int, limit: np.ndarray) -> np.ndarray:
        """Samples ``lo`` to ``hi`` of a track of which ``x`` begins at ``first`` and holds what their frames and those around them need."""
        n_fft, hop, every = self.n_fft, self.hop, n_frames(total, self.n_fft, self.hop)
        f0, f1 = max(0, lo // hop), min(every, -(-(hi + n_fft - hop) // hop))  # those that overlap the samples
        g0, g1 = max(0, f0 - self.reach), min(every, f1 + self.reach)
        z = frames_of(first, x, g0, g1, n_fft, hop)
        mask = _smoothed(_smoothed((decibels(z) > limit).astype(np.float64), self.over_bins, 1), self.over_frames, 0)
        z *= 1 - self.reduction * (1 - mask)
        back = np.fft.irfft(z[f0 - g0 : f1 - g0], n=n_fft, axis=1)
        return added(back, np.arange(f0, f1), lo, hi, n_fft, hop) / float((hann(n_fft) ** 2)[::hop].sum())


def gate_array(
    x: np.ndarray, profile: np.ndarray, rate: int = 16000, n_fft: int = GATE_FFT, hop: int = GATE_HOP, deviations: float = 1.5, reduction: float = 1.0, smooth_hz: float = 500.0, smooth_ms: float = 50.0
) -> np.ndarray:
    """``spectral_gate`` of one whole track with the noise of ``profile``."""
    x = np.asarray(x, dtype=np.float64)
    if not len(x):
        return x.astype(np.float32)
    limit = noise_floor(np.asarray(profile, dtype=np.float64), n_fft, hop, deviations)
    return Gate.of(rate, n_fft, hop, reduction, smooth_hz, smooth_ms).gated(0, x, 0, len(x), len(x), limit).astype(np.float32)


def spectral_gate(
    blocks: DataFrame, keys: list[str], rate: int = 16000, profile: int = 8000, n_fft: int = GATE_FFT, hop: int = GATE_HOP, deviations: float = 1.5, reduction: float = 1.0,
    smooth_hz: float = 500.0, smooth_ms: float = 50.0, block: int = BLOCK,
) -> DataFrame:
    """``keys, start, total, samples`` without stationary noise, whose statistics by bin come from the first ``profile`` samples of each track.

    A bin of a frame is kept where it is louder than the profile's mean by so many ``deviations`` (in decibels); this mask is smoothed by
    triangles over frequency and time, and what is masked is lowered by ``reduction`` (1 removes it, 0 changes nothing). Blocks come
    with the frames around them, so frames are made where they are used and only samples are shuffled; the
    profile, ``profile`` samples at most, is joined by track, whose skew Spark splits.
    """
    gate = Gate.of(rate, n_fft, hop, reduction, smooth_hz, smooth_ms)
    size = max(1, block // hop) * hop
    halo = n_fft + gate.reach * hop
    head = reblock(blocks.where(F.col("start") < profile), keys, profile).where("k = 0")

    def floor_of(k: int, first: int, total: int, x: np.ndarray) -> dict:
        return {"floor": [noise_floor(window_of(first, x, 0, max(1, min(profile, total))), n_fft, hop, deviations)]}

    floors = by_row(head, keys, floor_of, "floor array<double>")

    def work(k: int, first: int, total: int, x: np.ndarray, limit: np.ndarray) -> dict:
        lo, hi = k * size, min(total, (k + 1) * size)
        return {"start": [lo], "total": [total], "samples": [gate.gated(first, x, lo, hi, total, limit).astype(np.float32)]}

    near = reblock(blocks, keys, size, halo, halo).join(floors, keys)
    return by_row(near, keys, work, "start long, total long, samples array<float>", "floor")


def _smoothed(mask: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis; beyond its ends there is nothing."""
    reach = len(w) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    padded = np.pad(mask, pad)
    return np.lib.stride_tricks.sliding_window_view(padded, len(w), axis=axis) @ w


def mel_weights(rate: int = 16000, n_fft: int = MEL_FFT, bands: int = MEL_BANDS, low: float = MEL_LOW, high: float = MEL_HIGH) -> np.ndarray:
    """Triangles over the bins, even on the mel scale ``1127 * ln(1 + f / 700)``, by bin and band; the bin of zero weighs nothing."""

    def mel(f):
        return 1127.0 * np.log1p(np.asarray(f) / 700.0)

    bins = mel(np.arange(n_fft // 2 + 1) * rate / n_fft)[:, None]
    edge = np.linspace(mel(low), mel(high), bands + 2)
    up, down = (bins - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - bins) / (edge[2:] - edge[1:-1])
    out = np.maximum(0.0, np.minimum(up, down))
    out[0] = 0
    return out


def mel_patches(blocks: DataFrame, keys: list[str], rate: int = 16000, block: int = BLOCK) -> DataFrame:
    """``keys, patch, mel``: patches of 0.96 s every 0.48 s as 96 by 64 log-mel values, frame after frame.

    A track is taken to end with zeros so that its last patch is whole; it has one patch at least, and as many as begin where
    samples are left that no patch before holds.
    """
    step, span = PATCH_HOP * MEL_HOP, (PATCH - 1) * MEL_HOP + MEL_FRAME
    size = max(1, block // step) * step
    weights = mel_weights(rate)

    def work(k: int, first: int, total: int, x: np.ndarray) -> dict | None:
        patches = 1 + max(0, -(-(total - span) // step))
        p0, p1 = k * size // step, min(patches, (k + 1) * size // step)
        if p1 <= p0:
            return None
        near = window_of(first, x, p0 * step, (p1 - 1) * step + span)
        frames = np.lib.stride_tricks.sliding_window_view(near, MEL_FRAME)[::MEL_HOP] * hann(MEL_FRAME)
        mel = np.log(np.abs(np.fft.rfft(frames, n=MEL_FFT, axis=1)) @ weights + MEL_OFFSET)
        return {"patch": np.arange(p0, p1), "mel": [mel[i * PATCH_HOP : i * PATCH_HOP + PATCH].reshape(-1).astype(np.float32) for i in range(p1 - p0)]}

    return by_row(reblock(blocks, keys, size, 0, span), keys, work, "patch long, mel array<float>")
