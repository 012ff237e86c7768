"""What Python tasks make, passed on in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes and rows after which a task passes on what it has made, about.
PART_BYTES, PART_ROWS = 1 << 20, 512


def in_parts(rows: Iterable[tuple[int, tuple]], made: Callable[[list[tuple]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``made`` of runs of rows that come with their bytes: a batch for each row is slow, one for all may be of any size."""
    part, used = [], 0
    for n, row in rows:
        part.append(row)
        used += n
        if used >= PART_BYTES or len(part) == PART_ROWS:
            yield made(part)
            part, used = [], 0
    if part:
        yield made(part)


def lists(values: Sequence[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """Arrays as lists; None as null."""
    sizes = np.array([0 if x is None else len(x) for x in values], dtype=np.int64)
    flat = pa.array(np.concatenate([np.zeros(0, dtype=kind.value_type.to_pandas_dtype()), *(x for x in values if x is not None)]), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat, mask=pa.array([x is None for x in values], pa.bool_()))
