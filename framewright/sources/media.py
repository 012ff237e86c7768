"""Media files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def video_id(path: Column, unique: bool = True) -> Column:
    """The name of a file without its extension, followed by sixteen digits of its path's digest unless ``unique`` is off: files of
    one name in other folders, or with another extension, stay apart."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat_ws("-", stem, F.left(F.sha2(path, 256), F.lit(16))) if unique else stem


def list_media(spark: SparkSession, path: str, glob: str = "*", unique: bool = True) -> DataFrame:
    """``video_id, path, length`` of the files below ``path``; the content column is pruned, so no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(video_id(F.col("path"), unique).alias("video_id"), "path", "length")
