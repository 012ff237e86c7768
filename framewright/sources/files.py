"""Contents as files, written by the tasks that hold the rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.sources.ranged import located


def write_files(contents: DataFrame, folder: str, name: str, content: str, suffix: str, encode: Callable[[pa.Scalar], bytes] | None = None) -> DataFrame:
    """``path, length`` of one file for each row; each attempt writes a part of its own and moves it, so a retried task leaves the same whole file.

    It is lazy like every DataFrame: files exist once its rows have been read. Null contents give empty files. ``encode`` makes the bytes
    of a value, null or not, in the task that writes them, one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names = [f"{k}{suffix}" for k in batch.column(0).to_pylist()]
            sizes = []
            for k, value in zip(names, batch.column(1), strict=True):
                data = encode(value) if encode else value.as_buffer() if value.is_valid else b""
                part = f"{root}/.{k}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, f"{root}/{k}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{k}" for k in names], pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

    value = F.col(content) if encode else F.col(content).cast("binary")
    return contents.select(F.col(name).cast("string"), value).mapInArrow(run, "path string, length long")
