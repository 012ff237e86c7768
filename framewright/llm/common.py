"""What several operators share: tables in the shared folder, checked broadcasts, word counts, batches cut by bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that may be broadcast; a side that takes more is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of input that a Python task works on at once, about, and rows at most; a longer value is taken whole.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 256


def shared_folder(df: DataFrame) -> str:
    """The cluster's checkpoint folder. Only a local session, as in tests, gets a temporary one where none is set."""
    context = df.sparkSession.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, columns can still be pruned,
    its size is known to the planner, and a lost executor loses none of it."""
    path = f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more: what was made from them must have been stored itself."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def _width(value: Column, kind: DataType) -> Column:
    """About the bytes that a value takes in a broadcast row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x: _width(x, kind.elementType))
        return F.coalesce(F.aggregate(each, F.lit(16).cast("bigint"), lambda a, x: a + x), F.lit(16))
    if isinstance(kind, MapType):
        raise TypeError("maps aren't broadcast here")
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (stored) marked for broadcast if its rows take at most ``most`` bytes, else as it is."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24)).cast("bigint")
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of the frames is named so in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches_by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes of a string or binary column at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = used = 0
        for i, n in enumerate(sizes):
            if i > start and (used + n > BATCH_BYTES or i - start == BATCH_ROWS):
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task, and what it holds then counts against the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, which gives memory back when it ends, also by an error."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
