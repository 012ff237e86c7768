"""Raw video frames as model input: channels reordered, resized, cropped, scaled and normalised, batch by batch.

Resizing is separable: one matrix of weights for each pair of sizes turns rows, one columns, so a frame is two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preparation:
    """``edge``: length of the shorter side after resizing; ``crop``: side of the square in the middle; ``order``: which channel of the input
    comes first, second and third (2, 1, 0 turns BGR into RGB); ``mean`` and ``deviation`` of values in 0 to 1, by channel of the output."""

    edge: int = 224
    crop: int = 224
    order: tuple[int, ...] = (2, 1, 0)
    mean: tuple[float, ...] = (0.45, 0.45, 0.45)
    deviation: tuple[float, ...] = (0.225, 0.225, 0.225)


@lru_cache(maxsize=64)
def resize_weights(n_in: int, n_out: int) -> np.ndarray:
    """Weights by output and input: triangles around each output's centre, as wide as the step where that is over one (which smooths what
    is made smaller), each row summing to one."""
    step = n_in / n_out
    center = (np.arange(n_out) + 0.5) * step
    w = np.maximum(0.0, 1 - np.abs(np.arange(n_in) + 0.5 - center[:, None]) / max(step, 1.0))
    return w / w.sum(axis=1, keepdims=True)


def prepared(frame: np.ndarray, plan: Preparation) -> np.ndarray:
    """``frame`` (height, width, channel; bytes) as float32 by channel, row and column. Resized values are rounded to bytes, halves up."""
    height, width, _ = frame.shape
    short = min(height, width)
    tall, wide = (plan.edge if n == short else max(plan.edge, int(plan.edge * n / short)) for n in (height, width))
    x = frame.astype(np.float64).transpose(2, 0, 1)[list(plan.order)]
    if (tall, wide) != (height, width):
        x = np.clip(np.floor(resize_weights(height, tall) @ x @ resize_weights(width, wide).T + 0.5), 0, 255)
    top, left = (tall - plan.crop) // 2, (wide - plan.crop) // 2
    x = x[:, top : top + plan.crop, left : left + plan.crop] / 255
    return ((x - np.array(plan.mean)[:, None, None]) / np.array(plan.deviation)[:, None, None]).astype(np.float32)


def prepare_frames(frames: DataFrame, frame: str = "frame", height: str = "height", width: str = "width", plan: Preparation = Preparation()) -> DataFrame:
    """``frames`` without its raw bytes, with ``tensor struct<shape, values>`` by channel, row and column, ``status`` and ``error``.

    A frame whose bytes aren't height times width times channels, a null one, or one without an extent gets a null tensor and an error.
    """
    if plan.crop > plan.edge:
        raise ValueError("the crop is larger than the resized frame")
    kept = [c for c in frames.columns if c not in (frame, "tensor", "status", "error")]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frames.select(*kept).schema)
    channels = len(plan.order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float32()))])
        for batch in batches:
            for i in range(batch.num_rows):
                data, tall, wide = (batch.column(len(kept) + k)[i] for k in range(3))
                h, w, n = tall.as_py() or 0, wide.as_py() or 0, len(data.as_buffer()) if data.is_valid else None
                if n is None or h < 1 or w < 1 or n != h * w * channels:
                    out, status, error = None, "error", f"{n} bytes are no frame of {w} by {h} and {channels} channels"
                else:
                    x = prepared(np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(h, w, channels), plan)
                    out, status, error = {"shape": list(x.shape), "values": x.reshape(-1)}, "ok", None
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[: len(kept)]), pa.array([out], kind), pa.array([status]), pa.array([error], pa.string())], [*kept, "tensor", "status", "error"])

    rows = frames.select(*kept, F.col(frame).cast("binary").alias("_frame"), F.col(height).cast("bigint").alias("_height"), F.col(width).cast("bigint").alias("_width"))
    return rows.mapInArrow(run, f"{types}tensor struct<shape:array<bigint>,values:array<float>>, status string, error string")
