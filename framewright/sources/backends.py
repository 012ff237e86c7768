"""The seam between Spark and decoders or pretrained models.

A backend is a picklable object; Spark ships it to the executors, where ``open()`` is called once for each task and
loads weights. Nothing here imports a model library: a backend imports its own inside ``open()``, on the executor, and
picks its device there.
"""

from __future__ import annotations

import importlib
from typing import Any, Protocol

import numpy as np


class MissingBackend(RuntimeError):
    """A library that a backend needs isn't installed on the executor."""


def require(module: str) -> Any:
    """``module``, or :class:`MissingBackend` that names it."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise MissingBackend(f"the backend needs the Python library {module!r} on every executor") from e


class Backend(Protocol):
    """What the pipelines call. Waveforms are mono float32 at 16 kHz; frames are uint8 RGB arrays."""

    def open(self) -> None:
        """Loads models once for each task."""

    def decode_audio(self, path: str) -> np.ndarray:
        """The waveform of a file: 16-bit PCM quantised, mono, 16 kHz."""

    def frame_count(self, path: str) -> int:
        """Frames by the container's metadata."""

    def read_frame(self, path: str, index: int) -> np.ndarray | None:
        """One RGB frame, or None if it can't be decoded."""

    def denoise(self, wave: np.ndarray, profile: np.ndarray) -> np.ndarray:
        """The waveform without stationary noise; only the transcript path uses it."""

    def transcribe(self, wave: np.ndarray) -> str | None:
        """The spoken text."""

    def encode_text(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""

    def encode_frames(self, frames: list[np.ndarray]) -> np.ndarray:
        """Hidden states by token; the first token stands for the clip."""

    def encode_speech(self, wave: np.ndarray) -> np.ndarray:
        """Hidden states by time step of one chunk; preprocessing is by chunk."""

    def encode_background(self, wave: np.ndarray) -> np.ndarray:
        """Embeddings by window of the whole waveform."""
