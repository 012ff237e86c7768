"""Vector functions over ``array<float|double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest norm that is divided by, so that a zero vector stays zero instead of raising.
EPS = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(vec: Column, eps: float = EPS) -> Column:
    """``vec / max(||vec||, eps)`` in doubles, returned as ``array<float>``. Null stays null; a zero vector stays zero."""

    def scaled(doubles: Column) -> Column:
        norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(F.greatest(norm, F.lit(eps)), lambda n: F.transform(doubles, lambda x: x / n))

    return let(vec.cast("array<double>"), scaled).cast("array<float>")


def zero_vector(dim: int) -> Column:
    """The embedding of an empty transcript: ``dim`` zeros."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
