"""Frame preparation and tensor columns against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import tensors
from framewright.operators.images import Preparation, prepare_frames, resize_weights


def plain(frame, plan):
    """Value by value."""
    h, w, c = frame.shape
    short = min(h, w)
    tall, wide = (plan.edge if n == short else max(plan.edge, int(plan.edge * n / short)) for n in (h, w))

    def weights(n_in, n_out, i):
        step = n_in / n_out
        out = [max(0.0, 1 - abs(j + 0.5 - (i + 0.5) * step) / max(step, 1.0)) for j in range(n_in)]
        return [x / sum(out) for x in out]

    out = np.zeros((c, plan.crop, plan.crop))
    top, left = (tall - plan.crop) // 2, (wide - plan.crop) // 2
    for y in range(plan.crop):
        for x in range(plan.crop):
            a, b = weights(h, tall, y + top), weights(w, wide, x + left)
            for k in range(c):
                v = sum(a[i] * b[j] * float(frame[i, j, plan.order[k]]) for i in range(h) for j in range(w) if a[i] and b[j])
                v = frame[y + top, x + left, plan.order[k]] if (tall, wide) == (h, w) else min(255, max(0, np.floor(v + 0.5)))
                out[k, y, x] = (v / 255 - plan.mean[k]) / plan.deviation[k]
    return out


@pytest.mark.parametrize("h, w", [(1, 1), (5, 9), (9, 5), (8, 8), (31, 17), (7, 40), (3, 3)])
def test_frames_equal_a_plain_loop(spark, h, w):
    plan = Preparation(edge=8, crop=6, mean=(0.4, 0.5, 0.6), deviation=(0.2, 0.3, 0.25))
    frame = np.random.default_rng(h * w).integers(0, 256, (h, w, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, frame.tobytes(), h, w)], "id int, frame binary, height int, width int")
    r = prepare_frames(df, plan=plan).first()
    assert (r.status, r.tensor.shape, r.height) == ("ok", [3, 6, 6], h)
    got, want = np.array(r.tensor["values"]).reshape(3, 6, 6), plain(frame, plan)
    apart = np.abs(got - want) > 1e-5
    assert not apart.any() or (apart.sum() <= 2 and np.abs(got - want).max() < 0.03)  # a value that falls on a half


def test_weights_keep_even_frames_even():
    for a, b in ((1, 9), (9, 1), (640, 224), (100, 101)):
        w = resize_weights(a, b)
        assert w.shape == (b, a) and np.allclose(w.sum(axis=1), 1) and (w >= 0).all()


def test_odd_frames_say_so(spark):
    rows = [(1, b"123", 2, 2), (2, None, 1, 1), (3, b"", 0, 5), (4, b"abc", None, 1), (5, b"abc", 1, 1), (6, b"abc", -1, -1)]
    got = {r.id: r for r in prepare_frames(spark.createDataFrame(rows, "id int, frame binary, height int, width int").withColumn("status", F.lit("clash"))).collect()}
    assert {i: r.status for i, r in got.items()} == {i: "ok" if i == 5 else "error" for i in range(1, 7)}
    assert got[1].tensor is None and "3 bytes" in got[1].error and len(got[5].tensor["values"]) == 3 * 224 * 224
    assert prepare_frames(spark.createDataFrame(rows, "id int, frame binary, height int, width int").limit(0)).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("t")).first().t


def made(shape):
    x = np.arange(int(np.prod(shape)), dtype=np.float32).reshape(shape)
    return x, tensors.tensor(F.array(*[F.lit(float(v)) for v in x.reshape(-1)]).cast("array<float>") if x.size else F.array().cast("array<float>"), F.array(*[F.lit(n) for n in shape]).cast("array<bigint>"))


def same(row, x):
    return tuple(row.shape) == x.shape and np.array_equal(np.array(row["values"], dtype=np.float32), x.reshape(-1))


def test_shape_algebra(spark):
    for shape in ((2, 3, 4), (1, 1, 3, 2), (1, 2), (4,), (2, 0, 3)):
        x, t = made(shape)
        assert same(one(spark, t), x) and same(one(spark, tensors.unsqueeze(t)), x[None])
        for axis in range(len(shape)):
            for i in range(shape[axis]):
                assert same(one(spark, tensors.take(t, axis, i)), np.take(x, i, axis))
    x, t = made((1, 1, 3, 2))
    assert same(one(spark, tensors.squeeze_to(t, 2)), x[0, 0]) and same(one(spark, tensors.squeeze_to(t, 4)), x) and same(one(spark, tensors.squeeze_to(t, 9)), x)
    assert same(one(spark, tensors.reshape(t, F.array(F.lit(2), F.lit(3)).cast("array<bigint>"))), x.reshape(2, 3))


def test_batches(spark):
    for shape, want in (((2, 3, 1, 2), (1, 2, 3, 1, 2)), ((1, 2, 3, 1, 2), (1, 2, 3, 1, 2)), ((1, 1, 1, 2, 3, 1, 2), (1, 2, 3, 1, 2))):
        x, t = made(shape)
        assert same(one(spark, tensors.as_batch(t)), x.reshape(want))
    x, t = made((2, 2))
    assert same(one(spark, tensors.stack(F.array(t, t, t))), np.stack([x, x, x]))
    assert one(spark, tensors.stack(F.array().cast(f"array<{tensors.KIND}>"))) is None


def test_shapes_that_do_not_fit_raise(spark):
    _, wide = made((2, 1, 2, 3, 1, 2))
    _, flat = made((2, 2))
    _, other = made((4,))
    for bad, said in (
        (tensors.as_batch(wide), "can't be squeezed to 5 axes"), (tensors.as_batch(flat), "fewer than 4 axes"), (tensors.take(flat, 1, 2), "no place 2 on axis 1"), (tensors.take(flat, 2, 0), "no place 0 on axis 2"),
        (tensors.stack(F.array(flat, other)), "shapes differ"), (tensors.reshape(flat, F.array(F.lit(3)).cast("array<bigint>")), "doesn't hold 4 values"),
    ):
        with pytest.raises(Exception, match=said):
            one(spark, bad)


def test_null_tensors_stay_null(spark):
    none = F.lit(None).cast(tensors.KIND)
    for column in (tensors.unsqueeze(none), tensors.squeeze_to(none, 2), tensors.as_batch(none), tensors.take(none, 0, 0), tensors.tensor(F.lit(None).cast("array<float>"), F.array(F.lit(1).cast("bigint")))):
        assert one(spark, column) is None
