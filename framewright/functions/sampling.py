"""Index plans: which frames of a video and which sample ranges of an audio track are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_indices(n_total: Column, n_want: int) -> Column:
    """``n_want`` frame positions spread evenly over ``0..n_total-1``, as ``array<bigint>``.

    No frames give an empty array; with too few frames the last index repeats; ties round half to even, and both
    ends are included. The step is kept as a double, because exact fractions round differently for some odd ``n_want``.
    """
    if n_want < 1:
        raise ValueError("n_want must be positive")
    n = n_total.cast("bigint")
    slots = F.sequence(F.lit(0), F.lit(n_want - 1))
    repeated = F.transform(slots, lambda i: F.least(i.cast("bigint"), n - 1))
    if n_want == 1:
        spread = F.array(F.lit(0).cast("bigint"))
    else:
        step = (n - 1).cast("double") / F.lit(float(n_want - 1))
        spread = F.transform(slots, lambda i: F.when(i == n_want - 1, n - 1).otherwise(F.bround(i.cast("double") * step).cast("bigint")))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= n_want, repeated).otherwise(spread)


def chunk_bounds(n: Column, chunk: int, overlap: int = 0) -> Column:
    """Half-open chunks of ``n`` samples as ``array<struct<chunk_id,start,end>>``; empty for ``n <= 0``.

    The hop is ``max(1, chunk - overlap)`` and the plan stops at the first chunk that reaches ``n``, so an overlap adds no
    extra tail.
    """
    if chunk < 1:
        raise ValueError("chunk must be positive")
    hop = max(1, chunk - overlap)
    n = n.cast("bigint")
    last = F.when(n <= chunk, F.lit(0).cast("bigint")).otherwise(F.ceil((n - chunk) / F.lit(hop)).cast("bigint"))

    def bounds(i: Column) -> Column:
        start = i * hop
        return F.struct(i.cast("int").alias("chunk_id"), start.alias("start"), F.least(n, start + chunk).alias("end"))

    plan = F.transform(F.sequence(F.lit(0).cast("bigint"), last), bounds)
    return F.when(n > 0, plan).otherwise(F.array().cast("array<struct<chunk_id:int,start:bigint,end:bigint>>"))


def noise_profile_length(n: Column, seconds: float = 0.5, rate: int = 16000) -> Column:
    """Samples in the noise profile: ``seconds`` of audio, at most ``n``, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(int(seconds * rate)).cast("bigint"), n.cast("bigint")))


def pad_last(values: Column, n_want: int) -> Column:
    """Exactly ``n_want`` elements: a short array repeats its last element at the end, a long one is cut. Empty gives null."""
    padded = F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(F.lit(0), F.lit(n_want) - F.size(values))))
    return F.when(F.size(values) > 0, F.slice(padded, 1, n_want))
