"""The ``.npy`` source and sink: bit for bit, whole jobs or nothing."""

import io
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.sources import npy
from framewright.sources.ranged import reader


@pytest.fixture
def source(spark):
    return npy.register_npy(spark)


def vectors(spark, n=40):
    rng = np.random.default_rng(0)
    rows = [(f"v{i}", [float(np.float32(x)) for x in rng.normal(size=i % 7)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "name string, vec array<float>").repartition(4)


def test_bit_for_bit(source, tmp_path):
    rows, df = vectors(source)
    odd = [("odd", [float("nan"), float("inf"), -0.0, 1e-45])]
    df = df.unionByName(source.createDataFrame(odd, df.schema)).unionByName(source.createDataFrame([("none", None)], df.schema))
    df.write.format("npy").mode("append").save(str(tmp_path / "out"))
    files = sorted(os.listdir(tmp_path / "out"))
    assert files == sorted(f"{k}.npy" for k, _ in rows + odd)
    for k, v in rows + odd:
        x = np.load(tmp_path / "out" / f"{k}.npy")
        assert x.dtype == np.float32 and x.tobytes() == np.array(v, dtype=np.float32).tobytes()
    got = {r.name: r for r in source.read.format("npy").load(str(tmp_path / "out")).collect()}
    assert {k: np.array(r["values"], dtype=np.float32).tobytes() for k, r in got.items()} == {k: np.array(v, dtype=np.float32).tobytes() for k, v in rows + odd}
    assert got["odd"].dtype == "<f4" and list(got["odd"].shape) == [4]


def test_arrays_of_other_programs(source, tmp_path):
    want = {"f8": np.arange(6.0).reshape(2, 3), "fortran": np.asfortranarray(np.arange(6, dtype=np.int16).reshape(2, 3)), "scalar": np.array(3.5), "empty": np.zeros((0, 4), dtype=np.uint8), "big": np.arange(4, dtype=">f4"), "bool": np.array([True, False])}
    for k, x in want.items():
        np.save(tmp_path / f"{k}.npy", x)
    (tmp_path / "_hidden.npy").write_bytes(b"junk")
    (tmp_path / "other.txt").write_bytes(b"junk")
    for r in source.read.format("npy").load(f"file://{tmp_path}").collect():
        x = want.pop(r.name)
        assert tuple(r.shape) == x.shape and np.array_equal(np.array(r["values"]).reshape(x.shape), x)
    assert not want


def test_shapes_and_types_are_written(source, tmp_path):
    df = source.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2, 3])], "name string, vec array<double>, shape array<int>")
    df.write.format("npy").option("dtype", "<f8").mode("append").save(str(tmp_path))
    assert np.array_equal(np.load(tmp_path / "a.npy"), np.arange(1.0, 7).reshape(2, 3))


def test_overwrite_replaces_and_append_keeps(source, tmp_path):
    _, df = vectors(source, 6)
    out = str(tmp_path / "out")
    df.write.format("npy").mode("append").save(out)
    df.where("name = 'v5'").withColumn("vec", F.array(F.lit(7.0).cast("float"))).write.format("npy").mode("append").save(out)
    assert len(os.listdir(out)) == 6 and np.load(f"{out}/v5.npy").tolist() == [7.0]
    df.where("name < 'v2'").write.format("npy").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == ["v0.npy", "v1.npy"]


def test_a_failed_job_leaves_what_was_there(source, tmp_path):
    _, df = vectors(source, 20)
    out = str(tmp_path / "out")
    df.where("name = 'v1'").write.format("npy").mode("append").save(out)
    for bad in (
        df.withColumn("vec", F.when(F.col("name") == "v13", F.raise_error(F.lit("killed")).cast("array<float>")).otherwise(F.col("vec"))),
        df.withColumn("name", F.when(F.col("name") == "v13", "a/b").otherwise(F.col("name"))),
        df.withColumn("name", F.lit("same")),
    ):
        with pytest.raises(Exception):
            bad.write.format("npy").mode("overwrite").save(out)
        assert os.listdir(out) == ["v1.npy"]


def test_only_attempts_that_count_are_kept(tmp_path, source):
    """A speculated attempt that wrote all, and one that was killed half-way, beside those whose messages arrive."""
    rows, df = vectors(source, 10)
    w = npy.NpyWriter(str(tmp_path), df.schema, False, "<f4")
    batches = df.toArrow().combine_chunks().to_batches()
    kept = w.write(iter(batches))
    w.write(iter(batches))

    def dies():
        yield batches[0].slice(0, 3)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        w.write(dies())
    w.commit([kept])
    assert sorted(os.listdir(tmp_path)) == sorted(f"{k}.npy" for k, _ in rows)


def test_damaged_files_are_named(source, tmp_path):
    (tmp_path / "bad.npy").write_bytes(npy.array_bytes(np.arange(100.0))[:-8])
    with pytest.raises(Exception, match="bad.npy.*truncated"):
        source.read.format("npy").load(str(tmp_path)).collect()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=150))
def test_any_bytes_parse_or_are_refused(tail):
    for data in (tail, b"\x93NUMPY\x01\x00" + tail, b"\x93NUMPY\x01\x00\x76\x00{'descr': '<f4', 'fortran_order': False, 'shape': (" + tail):
        try:
            npy.parse_npy(reader(io.BytesIO(data), len(data)), len(data))
        except npy.NotNpy:
            pass


def test_nothing_to_read(source, tmp_path):
    assert source.read.format("npy").load(str(tmp_path)).count() == 0
