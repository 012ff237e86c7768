"""Edge cases against a plain Python model, and wrong recipes that the tests must detect."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import chunk_bounds, frame_indices, l2_normalize, noise_profile_length, pad_last, preview, seconds_label, unicode_strip


def model_indices(n, w):
    if n <= 0:
        return []
    if n <= w:
        return [min(i, n - 1) for i in range(w)]
    return [round(float(x)) for x in np.linspace(0, n - 1, w)]


@pytest.mark.parametrize("w", [1, 2, 3, 9, 15, 16, 21])
def test_frame_indices(spark, w):
    ns = [0, 1, 5, 6, 15, 16, 17, 45, 99, 300, 1234]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = {r.n: r.i for r in df.select("n", frame_indices(F.col("n"), w).alias("i")).collect()}
    assert got == {n: model_indices(n, w) for n in ns}


def test_half_up_is_wrong(spark):
    assert model_indices(6, 3) == [0, 2, 5] and math.floor(2.5 + 0.5) == 3


@pytest.mark.parametrize("chunk,overlap", [(10, 0), (10, 5), (10, 12), (7, 3)])
def test_chunks(spark, chunk, overlap):
    hop = max(1, chunk - overlap)

    def model(n):
        out, start = [], 0
        while start < n:
            end = min(n, start + chunk)
            out.append((len(out), start, end))
            if end == n:
                break
            start += hop
        return out

    df = spark.range(0, 45).withColumn("c", chunk_bounds(F.col("id"), chunk, overlap))
    assert {r.id: [tuple(x) for x in r.c] for r in df.collect()} == {n: model(n) for n in range(45)}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    got = [r.u for r in df.select(l2_normalize(F.col("v")).alias("u")).collect()]
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[1:] == [[0.0, 0.0], None, []]


def test_pad_last(spark):
    df = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3, 4],)], "v array<int>")
    assert [r.p for r in df.select(pad_last(F.col("v"), 3).alias("p")).collect()] == [[1, 2, 2], None, [1, 2, 3]]


def test_text(spark):
    raw = ["", None, "  ", "　x ", "\x1cword\x85", "a b", "\n\tz\n"]
    df = spark.createDataFrame([(x,) for x in raw], "t string")
    assert [r.s for r in df.select(unicode_strip(F.col("t")).alias("s")).collect()] == [(x or "").strip() for x in raw]
    long = ["x" * 120, "😀" * 121, ""]
    df = spark.createDataFrame([(x,) for x in long], "t string")
    assert [r.s for r in df.select(preview(F.col("t")).alias("s")).collect()] == [x[:120] + ("..." if len(x) > 120 else "") for x in long]


def test_seconds_label(spark):
    ns = [0, 1680, 16000, 123456789, *range(80, 4000, 80)]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [r.s for r in df.select(seconds_label(F.col("n")).alias("s")).collect()] == [f"{n / 16000:.2f}" for n in ns]
    assert [r.s for r in df.select(F.format_string("%.2f", F.col("n") / 16000).alias("s")).collect()] != [f"{n / 16000:.2f}" for n in ns]


def test_noise_profile(spark):
    df = spark.createDataFrame([(0,), (5,), (100_000,)], "n long")
    assert [r.p for r in df.select(noise_profile_length(F.col("n")).alias("p")).collect()] == [1, 5, 8000]
