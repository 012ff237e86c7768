"""A backend's decoding part for containers that are read here: WAVE files, and MP4 files with uncompressed frames.

Models are added by a subclass. Compressed video and audio need a decoder library, which a subclass brings by overriding
``decode_frame`` or ``decode_audio``.
"""

from __future__ import annotations

import numpy as np

from framewright.operators.audio import gate_array, resample_array
from framewright.sources.mp4 import Track, parse_mp4, spans
from framewright.sources.ranged import open_ranged, reader
from framewright.sources.wave import parse_wave, samples_of

#: Codes of uncompressed frames, and the order of their three channels as red, green and blue. Fixed values.
RAW_FRAMES = {"raw ": (0, 1, 2), "BGR ": (2, 1, 0)}


class ContainerDecoder:
    """``decode_audio``, ``frame_count``, ``read_frame`` and ``denoise`` of the backend protocol, by ranged reads; no library is needed."""

    rate = 16000

    def open(self) -> None:
        self._path: str | None = None
        self._track: Track | None = None

    def decode_audio(self, path: str) -> np.ndarray:
        """The samples of a WAVE file: mono, at ``rate``, as 16-bit integers hold them."""
        with open_ranged(path) as f:
            length = f.size()
            w = parse_wave(reader(f, length), length)
            f.seek(w.data_start)
            x = samples_of(f.read(w.total * w.stride), w.bits, w.floats, w.channels).mean(axis=1, dtype=np.float64)
        return (np.clip(np.rint(resample_array(x, w.rate, self.rate).astype(np.float64) * 32768), -32768, 32767) / 32768).astype(np.float32)

    def _video(self, path: str) -> Track:
        if self._path != path:
            with open_ranged(path) as f:
                length = f.size()
                tracks = [t for t in parse_mp4(reader(f, length), length) if t.kind == "vide"]
            if not tracks:
                raise ValueError("no video track")
            self._path, self._track = path, tracks[0]
        return self._track

    def frame_count(self, path: str) -> int:
        return len(self._video(path).sizes)

    def read_frame(self, path: str, index: int) -> np.ndarray | None:
        """One frame as red, green and blue, from the packets since its last keyframe; None if there is none or it can't be decoded."""
        t = self._video(path)
        if not 0 <= index < len(t.sizes):
            return None
        last = int(t.decode[index])
        first = last if t.keys[last] < 0 else int(t.keys[last])
        packets = []
        with open_ranged(path) as f:
            for a, b in spans(t.offsets[first : last + 1], t.sizes[first : last + 1]):
                f.seek(a)
                data = f.read(b - a)
                packets += [data[at - a : at - a + n] for at, n in zip(t.offsets[first : last + 1].tolist(), t.sizes[first : last + 1].tolist(), strict=True) if a <= at < b]
        return self.decode_frame(t, packets)

    def decode_frame(self, track: Track, packets: list[bytes]) -> np.ndarray | None:
        """The last of these packets as a picture (height, width, channel)."""
        order = RAW_FRAMES.get(track.codec)
        if order is None or not packets or len(packets[-1]) != track.width * track.height * 3 or not packets[-1]:
            return None
        return np.frombuffer(packets[-1], dtype=np.uint8).reshape(track.height, track.width, 3)[:, :, list(order)]

    def denoise(self, wave: np.ndarray, profile: np.ndarray) -> np.ndarray:
        return gate_array(wave, profile, self.rate)
