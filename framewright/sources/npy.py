"""``.npy`` files as a data source: one array a row, one file an array.

Register it with ``register_npy(spark)``; then ``df.write.format("npy").mode(...).save(folder)`` writes the rows of ``name, vec`` (and ``shape``, if
there is such a column), and ``spark.read.format("npy").load(folder)`` gives ``name, path, dtype, shape, values``.

Writing is two-phased. Each attempt of a task writes into a folder of its own under a staging folder; the driver moves the
files of the attempts that Spark counts, and then deletes the staging folder with whatever killed or speculated attempts left.
A job that fails leaves nothing but what was there before. A reader walks the header and reads the values; files are dealt to tasks by bytes.
"""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from framewright.sources.ranged import located, reader

SCHEMA = "name string, path string, dtype string, shape array<bigint>, values array<double>"
ARROW = pa.schema([("name", pa.string()), ("path", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])
#: Bytes and files of a reading task, about; files that the driver moves at once; bytes that a header takes at most.
TASK_BYTES, TASK_FILES, MOVES, HEADER_BYTES = 64 << 20, 1000, 32, 1 << 20
#: Times that the staging folder is deleted at most.
CLEARS = 5
STAGING = "_staging-"


class NotNpy(ValueError):
    """A file that isn't a ``.npy`` array of numbers."""


def array_bytes(values: np.ndarray) -> bytes:
    """The file of an array, of format version 1.0 where that can hold its header."""
    out = io.BytesIO()
    np.lib.format.write_array(out, values, allow_pickle=False)
    return out.getvalue()


def parse_npy(read, length: int) -> np.ndarray:
    """The array of a file, from ``read(at, n)``; raises :class:`NotNpy` for other files, arrays of objects and files whose values are cut."""
    head = read(0, 12)
    if len(head) < 10 or head[:6] != b"\x93NUMPY" or head[6] not in (1, 2, 3):
        raise NotNpy("no NPY magic")
    wide = head[6] > 1
    size = int.from_bytes(head[8 : 12 if wide else 10], "little")
    start = (12 if wide else 10) + size
    if size > HEADER_BYTES or start > length:
        raise NotNpy("its header is cut")
    try:
        f = io.BytesIO(read(8, start - 8))
        shape, fortran, dtype = (np.lib.format.read_array_header_2_0 if wide else np.lib.format.read_array_header_1_0)(f)
    except Exception as e:
        raise NotNpy(f"its header can't be read: {e}") from e
    if dtype.kind not in "biuf" or any(n < 0 for n in shape):
        raise NotNpy(f"values of kind {dtype} aren't read here")
    count = 1
    for n in shape:
        count *= int(n)
    if start + count * dtype.itemsize > length:
        raise NotNpy(f"truncated: {count} values are stated")
    values = np.frombuffer(read(start, count * dtype.itemsize), dtype=dtype)
    return values.reshape(shape, order="F" if fortran else "C")


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class NpyReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        store, root = located(self.folder)
        chosen = fs.FileSelector(root, recursive=True) if store.get_file_info(root).type == fs.FileType.Directory else [root]
        found = sorted((i.path, i.size or 0) for i in store.get_file_info(chosen) if i.type == fs.FileType.File and i.path.endswith(".npy") and STAGING not in i.path and not i.base_name.startswith((".", "_")))
        out, now, size = [], [], 0
        for f in found:
            now.append(f)
            size += f[1]
            if size >= TASK_BYTES or len(now) == TASK_FILES:
                out.append(Files(now))
                now, size = [], 0
        return [*out, Files(now)] if now or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.folder)
        for path, size in partition.paths:
            with store.open_input_file(path) as f:
                try:
                    x = parse_npy(reader(f, size), size)
                except NotNpy as e:
                    raise NotNpy(f"{path}: {e}") from e
            row = {"name": path.rsplit("/", 1)[-1].removesuffix(".npy"), "path": path, "dtype": x.dtype.str, "shape": list(x.shape), "values": x.reshape(-1).astype(np.float64)}
            yield pa.RecordBatch.from_pylist([row], ARROW)


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt and how many files it holds."""

    folder: str
    files: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool, dtype: str) -> None:
        self.folder, self.overwrite, self.dtype, self.names = folder, overwrite, dtype, schema.names
        self.staging = f"{STAGING}{uuid.uuid4().hex}"
        for c in ("name", "vec"):
            if c not in self.names:
                raise ValueError(f"a column {c!r} is needed; there are {self.names}")
        store, root = located(folder)
        store.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = located(self.folder)
        at, n = f"{root}/{self.staging}/{uuid.uuid4().hex}", 0
        store.create_dir(at, recursive=False)  # fails once the job has been given up
        for batch in iterator:
            shapes = batch.column(self.names.index("shape")).to_pylist() if "shape" in self.names else [None] * batch.num_rows
            for name, vec, shape in zip(batch.column(self.names.index("name")).to_pylist(), batch.column(self.names.index("vec")), shapes, strict=True):
                if not vec.is_valid:
                    continue
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"{name!r} can't name a file")
                x = vec.values.to_numpy(zero_copy_only=False).astype(self.dtype)
                with store.open_output_stream(f"{at}/{name}.npy") as f:
                    f.write(array_bytes(x if shape is None else x.reshape(shape)))
                n += 1
        return Written(at, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.folder)
        try:
            moves, names = [], set()
            for m in messages:
                found = [i for i in store.get_file_info(fs.FileSelector(m.folder)) if i.type == fs.FileType.File]
                if len(found) != m.files or names & {i.base_name for i in found}:
                    raise ValueError(f"two rows are named alike, or files are missing in {m.folder}")
                names |= {i.base_name for i in found}
                moves += [(i.path, f"{root}/{i.base_name}") for i in found]
            with ThreadPoolExecutor(MOVES) as pool:
                if self.overwrite:
                    old = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.path.endswith(".npy") and i.base_name not in names]
                    list(pool.map(store.delete_file, old))
                list(pool.map(lambda m: store.move(*m), moves))
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = located(self.folder)
        at = f"{root}/{self.staging}"
        for _ in range(CLEARS):  # tasks that are being killed may still add a file meanwhile
            if store.get_file_info(at).type != fs.FileType.Directory:
                return
            with contextlib.suppress(OSError):
                store.delete_dir(at)


class NpySource(DataSource):
    """Options: ``path``, and ``dtype`` for writing (``<f4`` unless given)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, overwrite, self.options.get("dtype", "<f4"))


def register_npy(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NpySource)
    return spark
