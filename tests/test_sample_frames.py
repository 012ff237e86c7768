"""Sampling in one pass against the plan and its gather."""

from pyspark.sql import functions as F

from framewright.operators import frame_gather, frame_plan, sample_frames


def test_equal_to_plan_and_gather(spark):
    rows = [(k, i * 10 + k, f"x{k}-{i}") for k, n in ((1, 1), (2, 3), (3, 16), (4, 17), (5, 100)) for i in range(n)] + [(None, 5, "null")]
    frames = spark.createDataFrame(rows, "k int, t long, x string").repartition(4).withColumn("slot", F.lit("clash"))
    for n in (1, 5, 16):
        got = sorted(map(tuple, sample_frames(frames, "k", ["t"], n).where("k IS NOT NULL").select("k", "slot", "frame_idx", "x").collect()))
        counts = frames.groupBy("k").agg(F.count("*").alias("n"))
        numbered = spark.createDataFrame([(k, i, f"x{k}-{i}") for k, i in ((r[0], int(r[2].split("-")[1])) for r in rows[:-1])], "k int, frame_idx long, x string")
        want = sorted(map(tuple, frame_gather(frame_plan(counts, "k", "n", n), numbered, "k").select("k", "slot", "frame_idx", "x").collect()))
        assert got == want and len(got) == 5 * n
    assert sample_frames(frames, "k", ["t"], 4).where("k IS NULL").count() == 4 and sample_frames(frames.limit(0), "k", ["t"]).count() == 0
