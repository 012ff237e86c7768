"""Embedding and transcript sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.sources.npy import register_npy

#: File names by modality, as ``<video_id>_<suffix>.npy``. Fixed values.
NPY_SUFFIX = {"text": "text_embedding", "video": "timesformer", "speech": "wav2vec2_sp", "background": "yamnet_bg"}


def write_embeddings(embeddings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by modality; ``array<float>`` comes back bit for bit."""
    embeddings.write.mode(mode).partitionBy("modality").parquet(path)


def write_transcripts(transcripts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet of ``video_id, text``. An empty transcript is stored as an empty string, so no stale row survives."""
    transcripts.select("video_id", "text").write.mode(mode).parquet(path)


def export_npy(embeddings: DataFrame, directory: str) -> None:
    """One ``.npy`` float32 file for each row with a vector, by the two-phase writer of ``npy``: killed and speculated attempts leave nothing."""
    known = F.create_map(*[F.lit(x) for pair in NPY_SUFFIX.items() for x in pair])
    name = F.concat_ws("_", F.col("video_id"), F.coalesce(F.try_element_at(known, F.col("modality")), F.col("modality")))
    register_npy(embeddings.sparkSession)
    embeddings.where("vec IS NOT NULL").select(name.alias("name"), F.col("vec").cast("array<float>").alias("vec")).write.format("npy").mode("append").save(directory)
