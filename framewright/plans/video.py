"""Registered queries of the video operators, with their DuckDB SQL. Texts stand in for videos: 64 characters are a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tensors import as_batch, stack, take
from framewright.operators.images import Preparation, prepare_frames
from framewright.session import read_table, shared_folder
from framewright.sources.files import write_files
from framewright.sources.mp4 import mp4_bytes, mp4_index, planned_packets, read_packets

#: Characters of a frame, and every how many frames one is a keyframe.
CHARACTERS, KEYED = 64, 7
PLAN = Preparation(edge=4, crop=4, mean=(0.5, 0.5, 0.5), deviation=(0.25, 0.25, 0.25))


def planned_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an MP4 file, written by tasks; 16 frames of each are planned, and read with the packets since their keyframes."""

    def video(text: str) -> bytes:
        frames = [text[k : k + CHARACTERS].encode() for k in range(0, len(text), CHARACTERS)]
        return mp4_bytes(frames, [k % KEYED == 0 for k in range(len(frames))])

    videos = read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    index = mp4_index(write_files(videos, shared_folder(spark), "doc_id", "text", ".mp4", lambda x: video(x.as_py())))
    read = read_packets(planned_packets(index))
    last = F.element_at("packets", -1)
    held = F.aggregate(F.transform("packets", lambda p: F.octet_length(p)), F.lit(0).cast("bigint"), lambda a, n: a + n)
    doc = F.regexp_extract("path", r"([^/]+)\.mp4$", 1).cast("bigint").alias("doc_id")
    return read.select(doc, "slot", "frame_idx", "pts", F.size("packets").cast("bigint").alias("n_packets"), held.alias("n_bytes"), F.sha2(last, 256).alias("frame_sha256"))


def frame_tensors(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's first 48 characters (repeated to as many) as a BGR frame of 4 by 4, prepared, made a batch and cut to its first channel."""
    text = F.col("text")
    filled = F.substring(F.repeat(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\x01-\x7f]", "~"), 48), 1, 48)
    frames = read_table(spark, d, "conversations").where(F.length("text") > 0).select("conv_id", "turn", F.encode(filled, "UTF-8").alias("frame"), F.lit(4).alias("height"), F.lit(4).alias("width"))
    ready = prepare_frames(frames, plan=PLAN)
    first = take(take(as_batch(stack(F.array("tensor", "tensor"))), 0, 0), 0, 1)  # batch, frame
    return ready.select("conv_id", "turn", "status", F.posexplode(take(first, 0, 0)["values"]).alias("i", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


QUERIES = {"planned_frames": planned_frames, "frame_tensors": frame_tensors}

ORACLES = {
    "planned_frames": f"""
      WITH n AS (SELECT doc_id, text, (length(text) + {CHARACTERS - 1}) // {CHARACTERS} AS n FROM documents WHERE length(text) > 0),
      p AS (SELECT doc_id, text, CAST(i AS INTEGER) AS slot,
                   CAST(CASE WHEN n <= 16 THEN least(i, n - 1) WHEN i = 15 THEN n - 1 ELSE round_even(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / 15.0::DOUBLE), 0) END AS BIGINT) AS frame_idx FROM n CROSS JOIN range(16) t(i))
      SELECT doc_id, slot, frame_idx, frame_idx * 40 AS pts, frame_idx % {KEYED} + 1 AS n_packets,
             strlen(text[frame_idx // {KEYED} * {KEYED} * {CHARACTERS} + 1:(frame_idx + 1) * {CHARACTERS}]) AS n_bytes, sha256(text[frame_idx * {CHARACTERS} + 1:(frame_idx + 1) * {CHARACTERS}]) AS frame_sha256 FROM p""",
    "frame_tensors": r"""
      WITH f AS (SELECT conv_id, turn, repeat(regexp_replace(text, '[^\x01-\x7f]', '~', 'g'), 48)[1:48] AS t FROM conversations WHERE length(text) > 0)
      SELECT conv_id, turn, 'ok' AS status, CAST(i AS INTEGER) AS i, round(CAST(CAST((unicode(t[3 * i + 3:3 * i + 3]) / 255.0::DOUBLE - 0.5) / 0.25 AS FLOAT) AS DOUBLE), 5) AS value FROM f CROSS JOIN range(16) r(i)""",
}
