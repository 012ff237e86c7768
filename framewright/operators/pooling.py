"""Pooling a sequence of vectors into one vector for each key, by partial and final vector states (see ``states``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.states import means, vector_sums


def mean_pool(hidden: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Unweighted mean over the rows of each key: ``keys, vec array<double>, n_frames``. Null vectors take no part."""
    return means(vector_sums(hidden, keys, vec), keys)


def weighted_mean_pool(chunks: DataFrame, keys: list[str], sum_vec: str = "sum_vec", count: str = "n_frames") -> DataFrame:
    """Global mean from per-chunk partial states: sum of the chunk sums over the sum of the chunk counts.

    This is the mean over frames, not the mean of the chunk means. A key whose counts sum to zero gets a null ``vec``.
    """
    pooled = means(vector_sums(chunks, keys, sum_vec, F.col(count)), keys)
    return pooled.withColumn("vec", F.when(F.col("n_frames") > 0, F.col("vec")))


def chunk_sums(hidden: DataFrame, keys: list[str], chunk: str, vec: str = "vec") -> DataFrame:
    """Partial state of each chunk: ``keys, chunk, sum_vec, n_frames``."""
    sums = vector_sums(hidden, [*keys, chunk], vec)
    return sums.select(*keys, chunk, F.col("_total").alias("sum_vec"), F.col("_n").alias("n_frames"))


def first_token(hidden: DataFrame, keys: list[str], position: str, vec: str = "vec") -> DataFrame:
    """The vector at the smallest position of each key, as an aggregate (no sort, no window)."""
    return hidden.groupBy(*keys).agg(F.min_by(vec, position).alias("vec"))
