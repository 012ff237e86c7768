"""New media files as a stream; each file is self-contained, so no state or watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.sources.media import video_id

#: The schema of Spark's binary file source, which a stream has to state.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def media_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, unique: bool = True) -> DataFrame:
    """``video_id, path, length`` of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(video_id(F.col("path"), unique).alias("video_id"), "path", "length")


def embed_stream(media: DataFrame, embed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Embeds each micro-batch and writes it below ``out`` in a folder of its own, so that a retried batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return media.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
