"""The four modality plans with the stub backend: shapes, failures, shared decode, sinks and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stub_backend import StubBackend

from framewright.operators import mean_pool, weighted_mean_pool
from framewright.operators.pooling import chunk_sums
from framewright.plans.modalities import TextConfig, audio_embeddings, embed_media, observed, video_embeddings
from framewright.sources import MissingBackend, export_npy, list_media, require, write_embeddings, write_transcripts
from framewright.streaming import embed_stream, media_stream


def media(spark, names):
    return spark.createDataFrame([(n, n) for n in names], "video_id string, path string")


def test_video(spark):
    got = {r.video_id: r for r in video_embeddings(media(spark, ["a_40", "b_3", "bad_9", "dark_9"]), StubBackend()).collect()}
    assert got["a_40"].dim == 4 and abs(np.linalg.norm(got["a_40"].vec) - 1) < 1e-6
    assert got["b_3"].vec == pytest.approx([0.0, 1 / 3**0.5, 1 / 3**0.5, 1 / 3**0.5])  # frames 0, 2, 2, ...: frame 1 failed
    assert got["bad_9"].status == "error" and got["bad_9"].vec is None and "frame count" in got["bad_9"].error
    assert "No frames decoded" in got["dark_9"].error
    with pytest.raises(Exception, match="frame count"):
        video_embeddings(media(spark, ["bad_9"]), StubBackend(), strict=True).collect()


def test_audio(spark):
    names = ["a_640000", "b_320001", "c_0", "bad_5", "d_1001"]
    vectors, texts = audio_embeddings(media(spark, names), StubBackend(), text=TextConfig(dim=4))
    got = {(r.video_id, r.modality): r for r in vectors.collect()}
    assert len(got) == 15
    assert {r.video_id: r.text for r in texts.collect()}["a_640000"] == "640000 samples"
    assert got["b_320001", "text"].vec == [0.0] * 4 and got["c_0", "text"].vec == [0.0] * 4
    assert got["a_640000", "background"].vec == [3.0] * 4
    assert got["c_0", "speech"].status == "no_frames" and got["c_0", "background"].status == "no_windows"
    assert got["bad_5", "speech"].status == "error" and got["bad_5", "text"].vec is None
    unit = np.array([1.0, 2.0, 0.0, -1.0]) / 6**0.5
    assert got["a_640000", "speech"].vec == pytest.approx(list(unit), abs=1e-6)
    assert got["b_320001", "speech"].vec == pytest.approx(list(unit), abs=1e-6)  # the tail of one sample is skipped


def test_mean_of_means_is_wrong(spark):
    df = spark.createDataFrame([("a", 0, [1.0]), ("a", 0, [1.0]), ("a", 0, [1.0]), ("a", 1, [5.0])], "k string, c int, vec array<double>")
    right = weighted_mean_pool(chunk_sums(df, ["k"], "c"), ["k"]).first()
    assert right.vec == [2.0] == mean_pool(df, ["k"]).first().vec and right.n_frames == 4
    assert mean_pool(df.groupBy("k", "c").agg(F.array(F.avg(F.col("vec")[0])).alias("vec")), ["k"]).first().vec == [3.0]


def test_sinks(spark, tmp_path):
    vectors = embed_media(media(spark, ["a_1000", "bad_7"]), StubBackend())
    write_embeddings(vectors, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 8 and back.where("vec IS NULL").count() == 4
    export_npy(back, str(tmp_path / "npy"))
    assert np.load(tmp_path / "npy" / "a_1000_yamnet_bg.npy").tolist() == [3.0] * 4
    write_transcripts(spark.createDataFrame([("a", "")], "video_id string, text string"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first().text == ""


def test_stream_and_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("x_500.mp4", "y_900.mp4"):
        (tmp_path / "in" / name).write_bytes(b"0")
    assert {r.video_id for r in list_media(spark, str(tmp_path / "in"), unique=False).collect()} == {"x_500", "y_900"}
    stream = media_stream(spark, str(tmp_path / "in"), unique=False).withColumn("path", F.col("video_id"))
    q = embed_stream(stream, lambda df: video_embeddings(df, StubBackend()), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_missing_library():
    with pytest.raises(MissingBackend, match="no_such_library"):
        require("no_such_library")


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for name in ("a/x.mp4", "b/x.mp4", "a/x.mov"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0")
    got = [r.video_id for r in list_media(spark, str(tmp_path)).collect()]
    assert len(set(got)) == 3 and all(v.startswith("x-") for v in got)


class FailsOnSomeTexts(StubBackend):
    def encode_text(self, texts):
        if any("1000" in t for t in texts):
            raise ValueError("no such words")
        return super().encode_text(texts)


def test_one_bad_text_fails_alone(spark):
    df = media(spark, ["a_1000", "b_1002", "c_1004"])
    got = {r.video_id: r for r in audio_embeddings(df, FailsOnSomeTexts())[0].where("modality = 'text'").collect()}
    assert got["a_1000"].status == "error" and "no such words" in got["a_1000"].error and got["a_1000"].vec is None
    assert got["b_1002"].status == got["c_1004"].status == "ok" and got["b_1002"].dim == 4
    with pytest.raises(Exception, match="no such words"):
        audio_embeddings(df, FailsOnSomeTexts(), strict=True)[0].collect()


def test_observed_counts(spark):
    from pyspark.sql import Observation

    into = Observation()
    n = observed(video_embeddings(media(spark, ["a_40", "bad_9"]), StubBackend()), into).collect()
    assert len(n) == 2 and into.get == {"rows": 2, "ok": 1, "failed": 1, "least_dim": 4, "most_dim": 4}
