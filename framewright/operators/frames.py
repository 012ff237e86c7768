"""Frame plans and chunk plans as rows, and the gather of planned frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import chunk_bounds, frame_indices, pad_last


def frame_plan(counts: DataFrame, key: str, n_total: str, n_want: int = 16) -> DataFrame:
    """``key, slot, frame_idx`` for each planned frame. A key without frames has no rows."""
    return counts.select(key, F.posexplode(frame_indices(F.col(n_total), n_want)).alias("slot", "frame_idx"))


def frame_gather(plan: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """The frames at the planned positions. Repeated indices fan out, so the plan is never de-duplicated."""
    return plan.join(frames, [key, "frame_idx"])


def sample_frames(frames: DataFrame, key: str, order: list[str | Column], n_want: int = 16) -> DataFrame:
    """``frames`` at evenly spread positions of each key, with ``slot`` and ``frame_idx``; a position that is planned again comes again.

    Frames are counted and numbered in one pass over one shuffle, and each finds its own slots, so there is no plan to join. Should
    the frames have columns named like those, they are replaced.
    """
    by = W.partitionBy(key)
    numbered = frames.drop("slot", "frame_idx").withColumn("frame_idx", (F.row_number().over(by.orderBy(*order)) - 1).cast("bigint"))
    plan = F.transform(frame_indices(F.count("*").over(by), n_want), lambda x, i: F.when(x == F.col("frame_idx"), i))
    return numbered.withColumn("slot", F.filter(plan, lambda i: i.isNotNull())).withColumn("slot", F.explode("slot"))


def keep_decoded(gathered: DataFrame, key: str, value: str, decoded: str, n_want: int = 16) -> DataFrame:
    """Drops frames that failed to decode, keeps slot order and repeats the last good frame at the end.

    ``frames`` is null where no frame of the key decoded.
    """
    good = F.collect_list(F.when(F.col(decoded), F.struct("slot", value)))
    ordered = F.transform(F.array_sort(good), lambda s: s[value])
    return gathered.groupBy(key).agg(pad_last(ordered, n_want).alias("frames"))


def chunk_plan(counts: DataFrame, key: str, n: str, chunk: int = 320_000, overlap: int = 0) -> DataFrame:
    """``key, chunk_id, start, end`` for each chunk of a sample sequence. A key without samples has no rows."""
    return counts.select(key, F.inline(chunk_bounds(F.col(n), chunk, overlap)))
