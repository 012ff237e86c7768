"""Tensors as columns: ``struct<shape array<bigint>, values array<float>>`` with values in row order. All JVM-side; shapes that don't fit raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.vectors import let

KIND = "struct<shape:array<bigint>,values:array<float>>"


def _product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, n: a * n)


def _made(shape: Column, values: Column) -> Column:
    return F.struct(shape.cast("array<bigint>").alias("shape"), values.cast("array<float>").alias("values"))


def _checked(ok: Column, then: Column, *words: Column | str) -> Column:
    said = F.concat(*[F.lit(w) if isinstance(w, str) else F.coalesce(w.cast("string"), F.lit("null")) for w in words])
    return F.when(ok, then).otherwise(F.raise_error(said).cast(KIND))


def _shown(shape: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(shape, lambda n: n.cast("string")), ", "), F.lit("]"))


def tensor(values: Column, shape: Column) -> Column:
    """``values`` in this shape; raises unless its product is their number. Null if either is null."""
    made = let(_made(shape, values), lambda t: _checked(_product(t["shape"]) == F.size(t["values"]), t, "shape ", _shown(t["shape"]), " doesn't hold ", F.size(t["values"]), " values"))
    return F.when(values.isNotNull() & shape.isNotNull(), made)


def rank(t: Column) -> Column:
    return F.size(t["shape"])


def reshape(t: Column, shape: Column) -> Column:
    return tensor(t["values"], shape)


def unsqueeze(t: Column) -> Column:
    """One more axis of length 1 in front."""
    return F.when(t.isNotNull(), _made(F.concat(F.array(F.lit(1).cast("bigint")), t["shape"]), t["values"]))


def squeeze_to(t: Column, axes: int) -> Column:
    """Leading axes of length 1 removed until ``axes`` are left; raises where a leading axis is longer, which a loop would try for ever."""

    def cut(s: Column) -> Column:
        extra = F.size(s["shape"]) - axes
        head = F.slice(s["shape"], F.lit(1), F.greatest(F.lit(0), extra))
        rest = F.when(extra > 0, F.slice(s["shape"], extra + 1, F.lit(axes))).otherwise(s["shape"])
        return _checked(_product(head) == 1, _made(rest, s["values"]), "shape ", _shown(s["shape"]), f" can't be squeezed to {axes} axes")

    return F.when(t.isNotNull(), let(t, cut))


def as_batch(t: Column, axes: int = 5) -> Column:
    """A batch of ``axes`` axes: one axis less gets a batch of one, more are squeezed; raises for fewer."""
    few = F.raise_error(F.concat(F.lit("shape "), _shown(t["shape"]), F.lit(f" has fewer than {axes - 1} axes"))).cast(KIND)
    return F.when(t.isNull(), F.lit(None).cast(KIND)).when(rank(t) < axes - 1, few).when(rank(t) == axes - 1, unsqueeze(t)).otherwise(squeeze_to(t, axes))


def take(t: Column, axis: int, index: int) -> Column:
    """The part at one place of an axis, which goes; raises where there is none."""

    def cut(s: Column) -> Column:
        shape = s["shape"]
        n = F.get(shape, F.lit(axis))
        inner = _product(F.slice(shape, F.lit(axis + 2), F.size(shape)))
        outer = _product(F.slice(shape, F.lit(1), F.lit(axis)))
        blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), outer - 1), lambda o: F.slice(s["values"], ((o * n + index) * inner + 1).cast("int"), inner.cast("int")))
        values = F.when((outer > 0) & (inner > 0), F.flatten(blocks)).otherwise(F.array().cast("array<float>"))
        rest = F.concat(F.slice(shape, F.lit(1), F.lit(axis)), F.slice(shape, F.lit(axis + 2), F.size(shape)))
        return _checked((F.size(shape) > axis) & (n > index), _made(rest, values), "shape ", _shown(shape), f" has no place {index} on axis {axis}")

    return F.when(t.isNotNull(), let(t, cut))


def stack(tensors: Column) -> Column:
    """An array of tensors of one shape as one tensor with one more axis in front; raises where shapes differ, null for an empty array."""

    def made(s: Column) -> Column:
        shape = s[0]["shape"]
        return _checked(F.forall(s, lambda t: t["shape"] == shape), _made(F.concat(F.array(F.size(s).cast("bigint")), shape), F.flatten(F.transform(s, lambda t: t["values"]))), "shapes differ from ", _shown(shape))

    return F.when(F.size(tensors) > 0, let(tensors, made))
