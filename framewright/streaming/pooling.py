"""Means over chunks that arrive in any order: one row for each file once its last chunk is in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "total array<double>, n_frames bigint, seen binary, expected int"
OUT = "video_id string, vec array<double>, n_frames bigint, n_chunks int, status string"


def pool_stream(chunks: DataFrame, patience_ms: int = 600_000) -> DataFrame:
    """``video_id, vec, n_frames, n_chunks, status`` from a stream of ``video_id, chunk_id, n_chunks, sum_vec, n_frames``.

    The state of a file is the sum of its chunk sums, its frames so far, and one bit for each chunk that came, so a chunk that comes again counts
    once. With all ``n_chunks`` chunks the file's row goes out and its state goes; ``status`` is ``ok``, or ``no_frames`` with a null
    vector. A file that gets no chunk for ``patience_ms`` goes out as ``incomplete`` with the mean of what came. Null sums and
    chunk ids out of range take no part; a file whose last row went out starts anew if a chunk comes later. The timeout is by the clock, for
    which Spark keeps a query running: it doesn't end by itself under ``availableNow``.
    """

    def row(key: tuple[Any, ...], total: np.ndarray, n: int, came: int, status: str) -> pd.DataFrame:
        vec = (total / n).tolist() if n > 0 else None
        return pd.DataFrame({"video_id": [key[0]], "vec": [vec], "n_frames": [n], "n_chunks": [came], "status": [status if n > 0 or status == "incomplete" else "no_frames"]})

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n, seen, expected = np.zeros(0), 0, np.zeros(0, dtype=np.uint8), 0
        if state.exists:
            kept = state.get
            total, n, seen, expected = np.array(kept[0], dtype=np.float64), kept[1], np.unpackbits(np.frombuffer(kept[2], dtype=np.uint8)), kept[3]
        if state.hasTimedOut:
            state.remove()
            yield row(key, total, n, int(seen.sum()), "incomplete")
            return
        for pdf in frames:
            for chunk, count, vec, frames_ in zip(pdf["chunk_id"], pdf["n_chunks"], pdf["sum_vec"], pdf["n_frames"], strict=True):
                if vec is None or pd.isna(chunk) or pd.isna(count) or not 0 <= chunk < count:
                    continue
                expected = max(expected, int(count))
                if len(seen) < expected:
                    seen = np.concatenate([seen, np.zeros(-(-expected // 8) * 8 - len(seen), dtype=np.uint8)])
                if seen[int(chunk)]:
                    continue
                seen[int(chunk)] = 1
                x = np.nan_to_num(np.asarray(vec, dtype=np.float64))
                if len(total) < len(x):
                    total = np.concatenate([total, np.zeros(len(x) - len(total))])
                total[: len(x)] += x
                n += 0 if pd.isna(frames_) else int(frames_)
        came = int(seen.sum())
        if expected and came == expected:
            if state.exists:
                state.remove()
            yield row(key, total, n, came, "ok")
        elif expected:
            state.update((total.tolist(), n, np.packbits(seen).tobytes(), expected))
            state.setTimeoutDuration(patience_ms)

    own = chunks.where("video_id IS NOT NULL").select("video_id", "chunk_id", "n_chunks", F.col("sum_vec").cast("array<double>"), F.col("n_frames").cast("bigint"))
    return own.groupBy("video_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
